"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id", "lang", "source"])


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, sf_dir, "pages"))


def op4_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrapper import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_shard_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    df = shard(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan

    return digest(scan(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import groups

    df = groups(table(spark, sf_dir, "documents"), size=4)
    return df.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import linked

    return linked(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    taken = F.aggregate("taken", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op11_symmetric_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op12_tiled_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 100 == 0)


_ALL = (op1_warc, op2_shard_lpt, op3_secret_scan, op4_wrapper_text, op5_pack_windows, op6_language_crf, op7_minhash, op8_embedding_forest, op9_source_mix, op10_quality_rules, op11_symmetric_delete, op12_tiled_topk, op13_hard_negatives)
QUERIES = {f.__name__: f for f in _ALL}


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op3 SQL can say: the counts of the base kinds."""
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op10 SQL can say: the base columns, without the verdict of the sketches."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op9 SQL can say: sizes and targets, without the draws."""
    return op9_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def shard_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op2 SQL can say: the bytes in each shard, as plain scheduling one group at a time gives them."""
    return op2_shard_lpt(spark, sf_dir).groupBy("shard").agg(F.sum("size").alias("bytes"))


#: Parts of the operators' results that SQL can express, and the SQL of these and of whole operators, written from the contracts, not from the operators.
PARTS = {f.__name__: f for f in (secret_base_counts, quality_base, mix_targets, shard_loads)}
ORACLES = {
    "secret_base_counts": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id,
          len(list_filter(regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 12))::BIGINT AS n_assign,
          len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 18))::BIGINT AS n_access,
          len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda v: length(v) >= 16))::BIGINT AS n_hex
        FROM d""",
    "quality_base": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        windows AS (
          SELECT rid, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda k: array_to_string(ws[k : k + 7], ' '))) AS w FROM d WHERE len(ws) >= 8),
        twice AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS earlier FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1),
        repeats AS (SELECT rid, sum(least(8, coalesce(i - earlier, 8))) AS n FROM twice GROUP BY rid),
        lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)
        SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
          length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
          (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
          len(ws) < 20 OR 100 * coalesce(n, 0) > 30 * len(ws) AS base_failed
        FROM d JOIN lines USING (rid) LEFT JOIN repeats USING (rid)""",
    # The level at which weight times level, stopped at twice the size, adds up to the share: the last end of a source's rise below it, and the rest by weight.
    "mix_targets": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
        levels AS (SELECT 2.0::DOUBLE * source_size / weight AS level FROM s UNION SELECT 0),
        filled AS (
          SELECT level, sum(least(2.0::DOUBLE * source_size, weight * level)) AS held, sum(CASE WHEN 2.0::DOUBLE * source_size > weight * level THEN weight ELSE 0 END) AS rising
          FROM levels, s GROUP BY level),
        reached AS (SELECT * FROM filled WHERE held <= (SELECT 1.5::DOUBLE * sum(source_size) FROM s) ORDER BY level DESC LIMIT 1),
        final AS (SELECT level + CASE WHEN rising > 0 THEN ((SELECT 1.5::DOUBLE * sum(source_size) FROM s) - held) / rising ELSE 0 END AS level FROM reached)
        SELECT doc_id, size, source_size, round(least(2.0::DOUBLE * source_size, weight * level), 6) AS target
        FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, final""",
    "shard_loads": r"""
        WITH RECURSIVE g AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY bytes DESC) AS k, bytes
          FROM (SELECT sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents GROUP BY coalesce(text, ''))),
        run(k, loads) AS (
          SELECT 0::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]
          UNION ALL
          SELECT g.k, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + g.bytes ELSE x END)
          FROM run JOIN g ON g.k = run.k + 1),
        last AS (SELECT loads FROM run ORDER BY k DESC LIMIT 1)
        SELECT (i - 1)::INT AS shard, loads[i]::BIGINT AS bytes FROM last, range(1, 9) AS r(i) WHERE loads[i] > 0""",
    "op12_tiled_topk": r"""
        WITH v AS MATERIALIZED (
          SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op13_hard_negatives": r"""
        WITH v AS MATERIALIZED (
          SELECT vec_id::BIGINT AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (
          SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score
          FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        w AS (
          SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS n
          FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
        SELECT anchor_id, positive_id, n::INT AS rank, negative_id, positive_score, negative_score FROM w WHERE n <= 5""",
}
