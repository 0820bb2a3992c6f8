"""A training-data pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents, and keep columns of any other name as well. No stage fails on nulls in any column, empty or
very long texts, repeated rows or an empty table (whose result is empty); what becomes of each is in the stage's docstring. run() deletes the tables that a stage left in the
shared folder, and the result of the stage before, once its own result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varnika.llm import minhash, mixing, packing, quality, secrets
from varnika.llm.common import remove, shared_path, tables_made

#: Verified near copies and packing have no counterpart in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fences of their language and source; rejected ones go.

    Null and empty texts have under 20 words and go. A null language or source is a group of its own. Repeated rows are judged alike.
    """
    marked = docs.select(F.struct(*docs.columns).alias("_doc"), *[F.col(c).alias(f"_{c}") for c in ("text", "lang", "source")])
    judged = quality.quality_rules(marked, "_text", "_lang", "_source", carry=["_doc"], again=True)
    return judged.filter("kept").select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity of 0.8 or more): that of the smallest doc_id.

    Null and blank texts and rows of null doc_id link with nothing and stay. Of rows that are equal in all columns, one stays.
    """
    return minhash.deduplicated(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] or [EXAMPLE] in place of each secret, and n_chars to match where a text changed.

    Null and empty texts stay as they are; null sources are one owner; repeated rows are masked alike.
    """
    columns = docs.columns
    marked = docs.select(F.struct(*columns).alias("_doc"), F.col("text").alias("_text"), F.col("source").alias("_source"))
    found = secrets.scan(marked, "_text", "_source", carry=["_doc"], again=True)
    text = secrets.redacted(F.col("_doc.text"), F.col("_spans"))
    clean = F.when(F.size("_spans") > 0, text).otherwise(F.col("_doc.text"))
    made = found.select("_doc", "_spans", clean.alias("_clean"))
    n_chars = F.when(F.size("_spans") > 0, F.length("_clean")).otherwise(F.col("_doc.n_chars")) if "n_chars" in columns else None
    new = {"text": F.col("_clean"), "n_chars": n_chars}
    kinds = dict(docs.dtypes)
    return made.select(*[(new[c].cast(kinds[c]) if c in new else F.col(f"_doc.`{c}`")).alias(c) for c in columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: each up to twice, and in part where the mix holds only some of its blocks.

    Null and blank texts hold no word and go. Null sources are one source; repeated rows are documents of their own.
    """
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens.

    A null or empty text is one piece of the end id. Repeated rows and rows of null doc_id are documents of their own.
    """
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("pack", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name.replace(' ', '-')}")
        with tables_made() as made:
            stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, [*made, *before])  # nothing reads them any more
        before = [path]
        docs = spark.read.parquet(path)
    return docs
