"""The registered queries of the transliteration engine and the SQL that each must agree with.

Queries derive Devanagari from Latin names by a fixed letter table, in the same way in both engines.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varnika.functions import rules, text, vocab
from varnika.operators import batches, durable, evaluate, neural, numbering, pairs, training
from varnika.plans import neural_sql, spelling_sql
from varnika.sources import crawl, extract, io

LATIN = "abcdefghijklmnopqrstuvwxyz"
LETTERS = "अबचदएफगहइजकलमनओपखरसतउवभषयझ"
#: The same with vowel signs, virama, nukta and nasals for some letters, so that words hold all that the rules know.
SIGNED = "ाबचदेफग्िजकलमनोपखरसतुवँष़ं"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def devanagari(c: Column) -> Column:
    return F.translate(F.lower(c), LATIN, LETTERS)


def signed(c: Column) -> Column:
    return F.translate(F.lower(c), LATIN, SIGNED)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle.replace("{dev}", f"'{LATIN}', '{LETTERS}'").replace("{signed}", f"'{LATIN}', '{SIGNED}'")
        return f

    return add


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, hindi, english) of every part."""
    return table(spark, sf_dir, "part").select("p_partkey", devanagari(F.col("p_name")).alias("hindi"), F.lower("p_name").alias("english"))


_PART = "(select p_partkey, translate(lower(p_name), {dev}) as hindi, lower(p_name) as english from part)"
_CHARS = f"(select p_partkey, unnest(string_split(hindi, '')) as ch, generate_subscripts(string_split(hindi, ''), 1) - 1 as pos from {_PART})"
_VOCAB = f"(select ch, count(*) as n, count(distinct p_partkey) as docs, row_number() over (order by count(*) desc, min(p_partkey * 1000 + pos)) as id from {_CHARS} group by ch)"
_IDS = f"(select c.p_partkey, list(v.id order by c.pos) as ids from {_CHARS} c join {_VOCAB} v using (ch) group by c.p_partkey)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean pairs of several sources, best byte distance of a rule-based spelling for each word, and the share of exact ones."""
    return best_of_refs(spark, sf_dir)


@query("""select translate(lower(c_name), {dev}) as hindi, lower(c_name) as english from customer where not contains(c_name, '.') and not contains(c_name, ',') and strlen(c_name) = length(c_name)
union select translate(lower(s_name), {dev}), lower(s_name) from supplier where not contains(s_name, '.') and not contains(s_name, ',') and strlen(s_name) = length(s_name)
union select translate(lower(p_name), {dev}), lower(p_name) from part where not contains(p_name, '.') and not contains(p_name, ',') and strlen(p_name) = length(p_name)""")
def pairs_union_clean(spark, sf_dir):
    one = lambda t, c: table(spark, sf_dir, t).select(devanagari(F.col(c)).alias("hindi"), F.concat(F.lit("  "), c).alias("english"))
    return pairs.clean(pairs.union_sources(one("customer", "c_name"), one("supplier", "s_name"), one("part", "p_name")))


@query("""select distinct h as hindi, e as english from (select translate(lower(p_name), {dev}) h, lower(p_name) e from part union all select translate(lower(p_brand), {dev}), lower(p_brand) from part)
where not contains(e, '.') and not contains(e, ',')""")
def pairs_two_columns(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(devanagari(F.col("p_name")).alias("h1"), F.col("p_name").alias("e1"), devanagari(F.col("p_brand")).alias("h2"), F.col("p_brand").alias("e2"))
    return pairs.clean(pairs.to_pairs(df, [("h1", "e1"), ("h2", "e2")]))


@query("""select 'all' as stage, count(*) as n_rows, count(hindi) as n_hindi, count(english) as n_english from (select translate(lower(c_name), {dev}) as hindi, nullif(c_mktsegment, 'BUILDING') as english from customer)
union all select 'distinct', count(*), count(hindi), count(english) from (select distinct translate(lower(c_name), {dev}) as hindi, lower(c_mktsegment) as english from customer where c_mktsegment <> 'BUILDING')""")
def clean_audit(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(devanagari(F.col("c_name")).alias("hindi"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("english"))
    return pairs.audit(df, "all").unionByName(pairs.audit(pairs.clean(df), "distinct"))


@query("select doc_id, lang from documents where strlen(text) = length(text)")
def ascii_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(text.is_ascii(F.col("text"))).select("doc_id", "lang")


@query("select doc_id from documents where not contains(text, '.') and not contains(text, ',')")
def no_abbrev(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(~F.col("text").contains(".") & ~F.col("text").contains(",")).select("doc_id")


@query("select conv_id, turn, role from conversations where nullif(role, 'system') is not null and text is not null")
def drop_nulls(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").withColumn("role", F.nullif("role", F.lit("system")))
    return df.dropna("any").select("conv_id", "turn", "role")


@query(f"select ch, count(*) as n from {_CHARS} group by ch")
def char_tf(spark, sf_dir):
    return vocab.char_rows(_part(spark, sf_dir), "hindi", "p_partkey").groupBy("ch").agg(F.count("*").alias("n"))


@query(f"select ch, count(distinct p_partkey) as docs from {_CHARS} group by ch")
def char_df(spark, sf_dir):
    return _part(spark, sf_dir).select(F.explode(F.array_distinct(text.chars(F.col("hindi")))).alias("ch")).groupBy("ch").agg(F.count("*").alias("docs"))


@query("select count(*) as n_docs, max(length(p_name)) as max_chars, min(length(p_name)) as min_chars, sum(length(p_name))::bigint as n_chars from part")
def doc_count(spark, sf_dir):
    n = F.length("p_name").cast("long")
    return table(spark, sf_dir, "part").agg(F.count("*").alias("n_docs"), F.max(n).alias("max_chars"), F.min(n).alias("min_chars"), F.sum(n).alias("n_chars"))


@query("""select 'documents' as tab, max(length(text)) as max_len from documents union all select 'benchmark', max(length(text)) from benchmark union all select 'conversations', max(length(text)) from conversations""")
def max_len(spark, sf_dir):
    one = lambda t: table(spark, sf_dir, t).agg(F.lit(t).alias("tab"), F.max(F.length("text").cast("long")).alias("max_len"))
    return one("documents").unionByName(one("benchmark")).unionByName(one("conversations"))


@query(f"select ch, n, docs, id from {_VOCAB}")
def vocab_rank(spark, sf_dir):
    return vocab.fit_vocab(_part(spark, sf_dir), "hindi", "p_partkey")


@query(f"select ch, row_number() over (order by ch) - 1 as id from (select distinct ch from {_CHARS})")
def vocab_alpha(spark, sf_dir):
    return vocab.alphabet(_part(spark, sf_dir), "hindi")


def _encoded(spark, sf_dir, spread: bool = False) -> DataFrame:
    """The parts with their ids, the vocabulary and its letters. spread: dealt over all tasks first, for work that is long for a few bytes of input."""
    df = _part(spark, sf_dir)
    df = df.repartition("p_partkey") if spread else df
    fitted = vocab.fit_vocab(df, "hindi", "p_partkey")
    # one row per character of the script
    table_ = fitted.agg(F.map_from_entries(F.collect_list(F.struct("ch", F.col("id").cast("int")))).alias("vocab"), F.transform(F.array_sort(F.collect_list(F.struct("id", "ch"))), lambda x: x["ch"]).alias("letters"))
    return df.crossJoin(F.broadcast(table_)).withColumn("ids", vocab.encode(F.col("hindi"), F.col("vocab")))


_text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@query(f"select p_partkey, array_to_string(ids, ' ') as ids from {_IDS}")
def encode_ids(spark, sf_dir):
    return _encoded(spark, sf_dir).select("p_partkey", _text(F.col("ids")).alias("ids"))


@query(f"select p_partkey, array_to_string(list_concat(ids[greatest(len(ids) - 11, 1):], list_transform(range(greatest(12 - len(ids), 0)), lambda x: 0)), ' ') as ids from {_IDS}")
def pad_ids(spark, sf_dir):
    return _encoded(spark, sf_dir).select("p_partkey", _text(vocab.pad(F.col("ids"), 12)).alias("ids"))


@query(f"select p_partkey, hindi as decoded from {_PART}")
def decode_ids(spark, sf_dir):
    return _encoded(spark, sf_dir).select("p_partkey", vocab.decode(vocab.pad(F.col("ids"), 64), F.col("letters")).alias("decoded"))


@query(f"select p_partkey, array_to_string(ids[1:len(ids)-1], ' ') as input, array_to_string(ids[2:], ' ') as target from {_IDS}")
def teacher_shift(spark, sf_dir):
    df = _encoded(spark, sf_dir).select("p_partkey", vocab.teacher_pair(F.col("ids")).alias("x"))
    return df.select("p_partkey", _text(F.col("x.input")).alias("input"), _text(F.col("x.target")).alias("target"))


@query(f"select c.p_partkey as row_id, c.pos::bigint as t, v.id as idx from {_CHARS} c join {_VOCAB} v using (ch)")
def one_hot_sparse(spark, sf_dir):
    df = vocab.one_hot(_encoded(spark, sf_dir), "ids", "p_partkey")
    return df.select("row_id", F.col("t").cast("long").alias("t"), F.col("idx").cast("long").alias("idx"))


@query("select p_partkey, (rn // 64)::bigint as batch from (select p_partkey, row_number() over (order by p_partkey) - 1 as rn, count(*) over () as n from part) where rn // 64 < n // 64")
def batch_no(spark, sf_dir):
    return pairs.batches(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


_WORDS = "(select b.item_id, unnest(string_split(text, ' ')) as w from benchmark b)"


@query(f"select item_id, w, w2, levenshtein(w2, w)::bigint as edits, case when strlen(w) = 0 then case when strlen(w2) = 0 then 0.0 else 'inf'::double end else levenshtein(w2, w)::double / strlen(w) end as distance from (select item_id, w, lower(reverse(w)) as w2 from {_WORDS})")
def edit_distance(spark, sf_dir):
    df = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.split_words(F.col("text"))).alias("w")).withColumn("w2", F.lower(F.reverse("w")))
    return df.select("item_id", "w", "w2", text.byte_distance(F.col("w2"), F.col("w")).cast("long").alias("edits"), text.edit_distance(F.col("w2"), F.col("w")).alias("distance"))


_DIST = f"(select hindi, levenshtein(split_part(english, ' ', 1), english)::double / strlen(english) as distance from {_PART})"


def _distances(spark, sf_dir) -> DataFrame:
    df = _part(spark, sf_dir).withColumn("guess", F.split_part("english", F.lit(" "), F.lit(1)))
    return evaluate.distances(df, "guess", "english")


@query(f"select hindi, min(distance) as distance from {_DIST} where hindi is not null group by hindi")
def best_of_refs(spark, sf_dir):
    return evaluate.best_of(_distances(spark, sf_dir), "hindi")


@query(f"select count(*) as n, count(*) filter (distance = 0) as n_exact, avg((distance = 0)::int::double) as accuracy from (select hindi, min(distance) as distance from {_DIST} group by hindi)")
def exact_match(spark, sf_dir):
    return evaluate.exact_match(evaluate.best_of(_distances(spark, sf_dir), "hindi"))


@query(f"select least(h - lo, greatest(hi - lo - 1, 0))::bigint as bin, count(*) as n from (select round(distance * 100)::bigint as h, min(round(distance * 100)::bigint) over () as lo, max(round(distance * 100)::bigint) over () as hi from {_DIST}) group by 1")
def distance_hist(spark, sf_dir):
    return evaluate.histogram(_distances(spark, sf_dir))


@query("select o_orderkey, ('0x' || left(md5(o_orderkey::varchar), 8))::bigint % 5 <> 0 as is_train from orders")
def hash_split(spark, sf_dir):
    return pairs.hash_split(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "is_train")


@query("select o_orderkey, o_orderstatus from orders where o_orderdate::date > date '1996-04-08'")
def date_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderdate").cast("date") > F.lit("1996-04-08").cast("date")).select("o_orderkey", "o_orderstatus")


@query("select o_orderkey as match_id from orders where o_orderkey > 1000 and o_orderdate::date > date '1996-04-08'")
def id_filter(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return extract.recent_matches(df, 1000, "1996-04-08").select("match_id")


@query("select o.o_orderkey from orders o semi join (select page_id from pages where page_id % 7 <> 0) p on o.o_orderkey = p.page_id")
def exists_filter(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("match_url"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"))
    return extract.landed(m, p).select("o_orderkey")


@query("""select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as link from pages""")
def link_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(extract.links(F.col("html"))).alias("link"))


@query("""select page_id, regexp_extract(html, '<script>([^<]*)', 1) as script, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages""")
def script_extract(spark, sf_dir):
    get = lambda p: F.regexp_extract("html", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", get("<script>([^<]*)").alias("script"), get("<title>([^<]*)</title>").alias("title"))


@query("select page_id, replace(replace(replace(url, '/en/', '/series/'), '/series/', '/hindi/series/'), 'live-cricket-score', 'full-scorecard') as url from pages")
def url_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_rewrite(F.replace("url", F.lit("/en/"), F.lit("/series/"))).alias("url"))


@query("select event_id, event_type, props::json is not null as has_props, json_extract_string(props, '$.' || json_keys(props)[1]) as first_value from events")
def props_json(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    key = F.get(F.json_object_keys("props"), F.lit(0))
    value = F.try_element_at(F.from_json("props", "map<string,string>"), key)
    return df.select("event_id", "event_type", F.json_object_keys("props").isNotNull().alias("has_props"), value.alias("first_value"))


@query("select conv_id, turn, array_to_string(list_transform(string_split(text, ' '), lambda w: case when length(w) > 12 then '' else w end), ' ') as text from conversations")
def word_split_join(spark, sf_dir):
    words = F.transform(text.split_words(F.col("text")), lambda w: F.when(F.length(w) <= 12, w))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.join_words(words).alias("text"))


@query("select p_partkey, '^' || lower(p_name) || '$' as wrapped, lower(p_name) as bare from part")
def sentinel_wrap(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", text.wrap(F.lower("p_name")).alias("wrapped"))
    return df.withColumn("bare", F.regexp_replace(text.unwrap(F.col("wrapped")), r"^\^", ""))


@query("select p_partkey, p_name, row_number() over (order by p_partkey) as unique_id from part")
def surrogate_id(spark, sf_dir):
    return numbering.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "unique_id", 1)[0]


@query("select p_partkey, p_name from part order by p_partkey limit 5")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy("p_partkey").select("p_partkey", "p_name").limit(5)


@query("select p_brand, max_by(p_name, p_retailprice * 100000 - p_partkey) as best from part group by p_brand")
def argmax_per_group(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_name", F.expr("p_retailprice * 100000 - p_partkey")).alias("best"))


@query("""select distinct ch from (select unnest(string_split(lower(p_name), '')) as ch from part union all select unnest(string_split(lower(c_name), '')) from customer)""")
def char_set_union(spark, sf_dir):
    one = lambda t, c: table(spark, sf_dir, t).select(F.explode(text.chars(F.lower(c))).alias("ch"))
    return one("part", "p_name").union(one("customer", "c_name")).distinct()


@query("""select distinct unnest(string_split(text, '')) as ch from benchmark except select distinct unnest(string_split(lower(p_name), '')) from part""")
def vocab_gap(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.explode(text.chars(F.col("text"))).alias("ch")).distinct()
    return b.exceptAll(table(spark, sf_dir, "part").select(F.explode(text.chars(F.lower("p_name"))).alias("ch")).distinct())


@query("select l_returnflag, sum(l_extendedprice * (l_discount > 0.05)::int) / count(*) as masked_mean, count(*) as n from lineitem group by l_returnflag")
def masked_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((F.sum(F.col("l_extendedprice") * (F.col("l_discount") > 0.05).cast("int")) / F.count("*")).alias("masked_mean"), F.count("*").alias("n"))


@query(f"select p_partkey, levenshtein(split_part(english, ' ', 1), english)::double / strlen(english) as first_edit_distance, levenshtein(split_part(english, ' ', 2), english)::double / strlen(english) as second_edit_distance from {_PART}")
def compare_systems(spark, sf_dir):
    df = _part(spark, sf_dir).withColumns({"a": F.split_part("english", F.lit(" "), F.lit(1)), "b": F.split_part("english", F.lit(" "), F.lit(2))})
    return evaluate.compare(df, "english", {"first": "a", "second": "b"}).select("p_partkey", "first_edit_distance", "second_edit_distance")


_HINDI_WORDS = f"select unnest(string_split(hindi, ' ')) as word from {_PART}"
_TEXTS = f"(select hindi, string_agg(latin, ' ' order by place) as latin from (select hindi, unnest(string_split(hindi, ' ')) as word, unnest(range(len(string_split(hindi, ' ')))) as place from (select distinct hindi from {_PART})) join spelled using (word) group by hindi)"
_SIGNED_WORDS = "select unnest(string_split(translate(lower(text), {signed}), ' ')) as word from benchmark"


@query(spelling_sql.spelled(_HINDI_WORDS) + f"select p_partkey, hindi, latin from {_PART} join {_TEXTS} using (hindi)")
def translit_rules(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", "hindi", rules.transliterate(F.col("hindi")).alias("latin"))


def _signed_words(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.explode(text.split_words(signed(F.col("text")))).alias("word")).filter("word <> ''").distinct()


@query(spelling_sql.spelled(_SIGNED_WORDS) + "select word, latin from spelled where word <> ''")
def translit_signs(spark, sf_dir):
    return _signed_words(spark, sf_dir).select("word", rules.transliterate(F.col("word")).alias("latin"))


@query(spelling_sql.k_best("select * from (" + _SIGNED_WORDS + ") where word <> ''"))
def translit_k_best(spark, sf_dir):
    return rules.k_best(_signed_words(spark, sf_dir), "word", 5).select("word", "guess", F.col("cost").cast("int").alias("cost"), F.col("rank").cast("int").alias("rank"))


@query(spelling_sql.k_best("select * from (" + _SIGNED_WORDS + ") where word <> ''"))
def translit_k_best_lateral(spark, sf_dir):
    """The same from the table function, joined laterally."""
    rules.register_k_best(spark)
    return spark.sql("select word, guess, cost, rank from {words}, lateral transliterations(word, 5)", words=_signed_words(spark, sf_dir))


@query(spelling_sql.spelled(_HINDI_WORDS) + f"select p_partkey, hindi, latin from {_PART} join {_TEXTS} using (hindi)")
def translit_sql_function(spark, sf_dir):
    rules.register(spark)
    return spark.sql("select p_partkey, hindi, transliterate(hindi) as latin from {part}", part=_part(spark, sf_dir))


@query(spelling_sql.spelled(_HINDI_WORDS) + f"select count(*) as n, count(*) filter (distance = 0) as n_exact, avg((distance = 0)::int::double) as accuracy from (select hindi, min(levenshtein(latin, english)::double / strlen(english)) as distance from {_PART} join {_TEXTS} using (hindi) group by hindi)")
def translit_accuracy(spark, sf_dir):
    df = _part(spark, sf_dir).withColumn("latin", rules.transliterate(F.col("hindi")))
    return evaluate.exact_match(evaluate.best_of(evaluate.distances(df, "latin", "english"), "hindi"))


@query(spelling_sql.spelled(_SIGNED_WORDS) + "select status, count(*) as n from (select case when word = '' or latin <> '' then 'ok' else 'failed' end as status from spelled union all select 'null' from nation where n_nationkey % 2 = 0) group by status")
def translit_status(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(text.split_words(signed(F.col("text")))).alias("word")).distinct()
    missing = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.lit(None).cast("string").alias("word"))
    df = words.unionByName(missing).withColumn("latin", rules.transliterate(F.col("word")))
    return evaluate.with_status(df, "word", "latin").groupBy(F.col("result.status").alias("status")).agg(F.count("*").alias("n"))


VOCAB_IN, VOCAB_OUT = {c: i for i, c in enumerate(LETTERS, 1)}, {c: i for i, c in enumerate("^$" + LATIN, 1)}


_WEIGHTS = neural.random_weights(len(VOCAB_IN) + 1, len(VOCAB_OUT) + 1, seed=7)
_ADDITIVE = neural.random_weights(len(VOCAB_IN) + 1, len(VOCAB_OUT) + 1, 24, 24, seed=8, additive=True)


def _shipped_weights(spark, weights=_WEIGHTS) -> str:
    """Weights as a file that the driver ships to the executors; it lies in a folder of the driver that goes when the driver ends."""
    folder = tempfile.mkdtemp(prefix="varnika-weights-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"{os.path.basename(folder)}.npz")
    neural.save_weights(path, weights)
    spark.sparkContext.addFile(path)
    return path


@query(neural_sql.greedy(_HINDI_WORDS, _WEIGHTS, VOCAB_IN, VOCAB_OUT, 47, 20) + f"select p_partkey, hindi, latin from {_PART} join {_TEXTS} using (hindi)")
def neural_spell(spark, sf_dir):
    kernel = neural.transliterator(_shipped_weights(spark), VOCAB_IN, VOCAB_OUT, 47, 20)
    return evaluate.predict_distinct(_part(spark, sf_dir).select("p_partkey", "hindi"), "hindi", kernel, "latin")


@query(neural_sql.greedy(_HINDI_WORDS, _ADDITIVE, VOCAB_IN, VOCAB_OUT, 47, 20) + f"select p_partkey, hindi, latin from {_PART} join {_TEXTS} using (hindi)")
def neural_spell_additive(spark, sf_dir):
    """The same with additive attention."""
    kernel = neural.transliterator(_shipped_weights(spark, _ADDITIVE), VOCAB_IN, VOCAB_OUT, 47, 20)
    return evaluate.predict_distinct(_part(spark, sf_dir).select("p_partkey", "hindi"), "hindi", kernel, "latin")


def _part_words(spark, sf_dir) -> DataFrame:
    return _part(spark, sf_dir).select(F.explode(text.split_words(F.col("hindi"))).alias("word")).distinct()


@query(neural_sql.k_best(_HINDI_WORDS, _WEIGHTS, VOCAB_IN, VOCAB_OUT, 5, 47, 20))
def neural_k_best(spark, sf_dir):
    """Five spellings of each word of the parts' names, by beam search."""
    return neural.k_best(_part_words(spark, sf_dir), "word", _shipped_weights(spark), VOCAB_IN, VOCAB_OUT, 5, 47, 20).select("word", "guess", F.col("rank").cast("int").alias("rank"))


@query(neural_sql.loss(_HINDI_WORDS, _WEIGHTS, VOCAB_IN, VOCAB_OUT, f"translate(word, '{LETTERS}', '{LATIN}')", 47, 15))
def validation_loss(spark, sf_dir):
    """The loss of the words of the parts' names with the true previous letters, added up by the trainer's jobs."""
    latin = F.translate("word", LETTERS, LATIN)
    ids = lambda c, v, n: F.transform(vocab.pad(vocab.encode(c, vocab.as_map(v)), n), lambda x: x.cast("int"))
    pairs_ = _part_words(spark, sf_dir).select(ids(F.col("word"), VOCAB_IN, 47).alias("ids_in"), ids(F.concat(F.lit("^"), latin, F.lit("$")), VOCAB_OUT, 16).alias("ids_out"))
    loss, n, _ = training.summed(pairs_, _WEIGHTS, back=False)
    return spark.createDataFrame([(n, round(loss / n, 3) if n else None)], "n long, loss double")


#: The letters of a model that doesn't know all of them.
VOCAB_FEW = {c: i for c, i in VOCAB_IN.items() if c not in "झयष"}


@query(f"select case when regexp_matches(word, '[^{''.join(VOCAB_FEW)}]') then 'oov' else 'decoded' end as status, count(*) as n from (select distinct word from ({_HINDI_WORDS})) group by 1")
def neural_status(spark, sf_dir):
    """Words by what became of them in a model that lacks some letters. Whether a decoded one came to its end within 20 steps is the weights' affair, so both states are one here."""
    kernel = neural.checked_transliterator(_shipped_weights(spark), VOCAB_FEW, VOCAB_OUT, 47, 20, None)
    found = _part_words(spark, sf_dir).withColumn("result", kernel("word"))
    status = F.when(F.col("result.status").isin("ok", "unfinished"), "decoded").otherwise(F.col("result.status"))
    return found.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("select l_returnflag, n, n_used, round(loss, 6) as loss from (select l_returnflag, count(*) as n, count(*) filter (l_linenumber % 4 <> 0) as n_used, sum(case when l_linenumber % 4 <> 0 then -ln((l_discount + 0.01) / 0.2) else 0 end) / count(*) as loss from lineitem group by l_returnflag)")
def masked_loss(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", ((F.col("l_discount") + 0.01) / 0.2).alias("p"), (F.col("l_linenumber") % 4).alias("target"))
    return evaluate.masked_loss(df, "p", "target", by=["l_returnflag"]).withColumn("loss", F.round("loss", 6))


@query(f"select c.p_partkey as row_id, (c.pos - 1)::bigint as t, v.id as idx from {_CHARS} c join {_VOCAB} v using (ch) where c.pos > 0")
def one_hot_shifted(spark, sf_dir):
    df = vocab.shifted_one_hot(_encoded(spark, sf_dir), "ids", "p_partkey")
    return df.select("row_id", F.col("t").cast("long").alias("t"), F.col("idx").cast("long").alias("idx"))


@query(f"select p_partkey, array_to_string(list_concat(ids, ids), ' ') as ids from {_IDS}")
def tile_ids(spark, sf_dir):
    return _encoded(spark, sf_dir).select("p_partkey", _text(vocab.tile(F.col("ids"), 2)).alias("ids"))


@query("""select 0 as place, 'c_custkey' as name, 'bigint' as dtype, count(*) as n_rows, count(c_custkey) as n_values from customer
union all select 1, 'segment', 'string', count(*), count(nullif(c_mktsegment, 'BUILDING')) from customer union all select 2, 'c_acctbal', 'double', count(*), count(c_acctbal) from customer""")
def table_info(spark, sf_dir):
    return pairs.info(table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "c_acctbal"))


@query("select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'nan') as segment, nullif(c_mktsegment, 'BUILDING') as kept_null, c_nationkey::varchar as nation from customer")
def as_text(spark, sf_dir):
    segment = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.as_text(segment).alias("segment"), text.as_text(segment, None).alias("kept_null"), text.as_text(F.col("c_nationkey")).alias("nation"))


@query("select p_partkey, (row_number() over (order by md5('1|' || p_partkey)) - 1)::bigint as place from part")
def shuffled_rows(spark, sf_dir):
    return pairs.shuffled(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


@query("select item_id, (i - 1)::bigint as place, words[i] as words, sizes[i]::bigint as sizes from (select item_id, words, sizes, unnest(range(1, len(words) + 1)) as i from (select item_id, string_split(text, ' ') as words, list_transform(string_split(text, ' ')[2:], lambda w: length(w)) as sizes from benchmark))")
def zipped_lists(spark, sf_dir):
    words = text.split_words(F.col("text"))
    sizes = F.transform(F.slice(words, F.lit(2), F.size(words)), lambda w: F.length(w).cast("long"))
    df = pairs.zip_lists(table(spark, sf_dir, "benchmark").select("item_id", words.alias("words"), sizes.alias("sizes")), "words", "sizes")
    return df.select("item_id", F.col("place").cast("long").alias("place"), "words", "sizes")


@query("select event_type, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::double as seconds from events group by event_type")
def epoch_seconds(spark, sf_dir):
    return evaluate.elapsed(table(spark, sf_dir, "events"), ["event_type"], "ts")


@query("select event_id, 'Epoch ' || user_id || ' Loss ' || printf('%.4f', value) as line from events")
def report_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", evaluate.message("Epoch %d Loss %.4f", F.col("user_id"), F.col("value")).alias("line"))


@query("""select user_id, event_id, loss, best, (count(*) over (partition by user_id, best order by ts, event_id) - 1)::bigint as patience from
(select user_id, event_id, ts, value as loss, min(value) over (partition by user_id order by ts, event_id) as best from events)""")
def best_so_far(spark, sf_dir):
    return evaluate.best_so_far(table(spark, sf_dir, "events").withColumn("loss", F.col("value")), ["user_id"], ["ts", "event_id"], "loss").select("user_id", "event_id", "loss", "best", "patience")


@query("""select user_id, event_id, n::bigint as n, total / n as running_mean from (select user_id, event_id, count(*) over w as n, sum(round(value * 100)::bigint) over w / 100.0::double as total from events window w as (partition by user_id order by ts, event_id rows unbounded preceding))""")
def running_loss(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    df = numbering.running(df, ["user_id"], ["ts", "event_id"], n=("count", F.lit(1)), total=("sum", F.col("cents")))
    return df.select("user_id", "event_id", "n", (F.col("total") / F.lit(100.0) / F.col("n")).alias("running_mean"))


@query("select n_nationkey as epoch, 0.001::double / (1 + 0.01::double * n_nationkey) as rate from nation")
def rate_decay(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("epoch"), evaluate.decayed_rate(0.001, 0.01, F.col("n_nationkey")).alias("rate"))


@query("select count(*) as n, (count(*) // 64)::bigint as steps, 100.0::double * sum((('0x' || left(md5(o_orderkey::varchar), 8))::bigint % 5 <> 0)::int) / count(*) as train_percent from orders")
def steps_per_epoch(spark, sf_dir):
    df = pairs.hash_split(table(spark, sf_dir, "orders"), "o_orderkey")
    return df.agg(F.count("*").alias("n"), F.expr("count(*) div 64").alias("steps"), (F.lit(100.0) * F.count_if("is_train") / F.count("*")).alias("train_percent"))


@query("""select c_custkey, c_name as stripped, case when c_mktsegment = 'BUILDING' then null else c_mktsegment end as segment from customer""")
def strip_and_missing(spark, sf_dir):
    padded = F.concat(F.lit("　\t \x1c"), F.col("c_name"), F.lit(" \r\n"))
    segment = text.na_compat(F.when(F.col("c_mktsegment") == "BUILDING", "nan").otherwise(F.col("c_mktsegment")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.strip_ws(padded).alias("stripped"), segment.alias("segment"))


_PLAYER_PAGE = """<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"data":{"pageData":{"content":{"matchPlayers":{"teamPlayers":[{"players":[{"player":{"id":%s,"name":"%s","longName":"%s","indexName":"%s","gender":"M","countryTeamId":%s,"slug":"%s"}}]}]}}}}}}}</script></html>"""


@query("select p_partkey as id, translate(lower(p_name), {dev}) as hindi_name, translate(lower(p_name), {dev}) as hindi_long_name, p_name as english_name, 'M' as gender, p_size::bigint as country_id, p_brand as slug from part where p_partkey % 3 <> 0")
def players_extract(spark, sf_dir):
    hindi = devanagari(F.col("p_name"))
    page = F.format_string(_PLAYER_PAGE, F.col("p_partkey").cast("string"), hindi, hindi, F.col("p_name"), F.col("p_size").cast("string"), F.col("p_brand"))
    pages = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 != 0, page).otherwise("<p>none</p>").alias("html"))
    return extract.players(pages).drop("date_of_birth")


@query("select n_nationkey::bigint as unique_id, 'Party of ' || n_name as party_name, n_name as name_english, translate(lower(n_name), {dev}) as name_hindi, 'Seat ' || n_regionkey as assembly_constituency, 'Uploaded' as application_uploaded, '4' || n_regionkey as age from nation")
def candidate_fields(spark, sf_dir):
    row = lambda *v: F.concat(F.lit('<div class="row"><div>label</div><div>'), *v, F.lit("</div></div>"))
    para = lambda *v: row(F.lit("<div><p>"), *v, F.lit("</p></div>"))
    bold = lambda *v: para(F.lit("<b>"), *v, F.lit("</b>"))
    personal = lambda *v: F.concat(F.lit("<div><label>l</label><div><p>"), *v, F.lit("</p></div></div>"))
    name, region, none = F.col("n_name"), F.col("n_regionkey").cast("string"), F.lit("-")
    first = F.concat(row(F.lit("\n Party of "), name, F.lit("\n")), para(none), bold(name), bold(devanagari(name)), para(F.lit("Seat "), region), para(none), para(F.lit("Uploaded")), para(none))
    second = F.concat(*[personal(none) for _ in range(6)], personal(F.lit("4"), region))
    head = F.lit("<section>" + "<div>" * 4 + '<div class="card-body"><div><div><p>photo</p></div><div>')
    mid = F.lit("</div>" * 7 + '</section><section><div><div class="row">' + "<div>" * 5 + "<form><div><div>")
    html = F.concat(head, first, mid, second, F.lit("</div></div></form>" + "</div>" * 7 + "</section>"))
    df = extract.candidates(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("unique_id"), html.alias("html")), "unique_id")
    one = lambda c: F.array_join(c, ",").alias(c)
    return df.select("unique_id", "party_name", "name_english", "name_hindi", "assembly_constituency", one("application_uploaded"), one("age"))


@query("""select page_id, contains(html, 'rel="next"') as has_next, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::bigint as n_links, regexp_extract_all(html, 'href="([^"]*)"', 1)[1] as first_link from pages""")
def page_links(spark, sf_dir):
    found = extract.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", extract.has_next(F.col("html")).alias("has_next"), F.size(found).cast("long").alias("n_links"), extract.first_field(found).alias("first_link"))


@query("select p_partkey, p_name from part order by md5('1|' || p_partkey || '|' || p_name) limit 10")
def random_rows(spark, sf_dir):
    return pairs.sample_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name"), 10)


@query("""with recursive found(page, depth) as (select 0::bigint, 0 union
select d, depth + 1 from (select depth, unnest([2 * page + 1, 3 * page + 2]) as d from found) where d in (select page_id from pages where page_id % 5 <> 4))
select page, min(depth)::int as depth from found group by page""")
def crawl_reach(spark, sf_dir):
    """Pages of one site that a crawl reaches: each links to two others in several ways, back to the first, and wherever its own html does; every fifth lies in a foreign domain."""
    n = F.col("page_id")
    site = F.when(n % 5 == 4, "http://other.example/p/").otherwise("HTTP://Site.Example:80/p/./")
    more = F.format_string('<a href="/p/%d#top"><a href="x/../%d"><a href="http://site.example/p/0"><a href="mailto:x@site.example"><a href="http://other.example/p/4">', 2 * n + 1, 3 * n + 2)
    pages = table(spark, sf_dir, "pages").select(F.concat(site, n.cast("string")).alias("url"), F.concat(more, F.coalesce("html", F.lit(""))).alias("html"))
    found = crawl.reach(pages, ["http://site.example/p/0"], ["site.example"])
    return found.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page"), "depth")


@query("""select event_id, case when event_id % 7 = 0 then 'malformed' end as reason, case when event_id % 7 <> 0 then json_extract_string(props, '$.' || json_keys(props)[1]) end as first_value
from events where props is not null""")
def quarantine(spark, sf_dir):
    """Records of every event, every seventh of which was cut off: the good ones, parsed, and the others with the reason."""
    df = table(spark, sf_dir, "events").filter("props is not null").select("event_id", F.when(F.col("event_id") % 7 == 0, F.left("props", F.length("props") - 1)).otherwise(F.col("props")).alias("props"))
    good, bad = io.quarantined(df, "props", "map<string,string>")
    value = F.try_element_at("props", F.get(F.map_keys("props"), F.lit(0)))
    return good.select("event_id", F.lit(None).cast("string").alias("reason"), value.alias("first_value")).unionByName(bad.select("event_id", "reason", F.lit(None).cast("string").alias("first_value")))


@query(f"""select p_partkey as row_id, (12 * (m + 1))::bigint as size, list_sum(list_transform(padded, lambda x, i: case when x > 0 then (i - 1) * (m + 1) + x else 0 end))::bigint as places, len(list_filter(padded, lambda x: x > 0))::bigint as ones
from (select p_partkey, list_concat(ids[greatest(len(ids) - 11, 1):], list_transform(range(greatest(12 - len(ids), 0)), lambda x: 0)) as padded, (select max(id) from {_VOCAB}) as m from {_IDS})""")
def one_hot_dense(spark, sf_dir):
    """The dense tensors of the padded ids, by their size, their number of ones and the sum of the ones' places."""
    size = F.size("letters") + 1
    dense = vocab.dense_one_hot(vocab.pad(F.col("ids"), 12), 12, size)
    df = _encoded(spark, sf_dir, spread=True).select(F.col("p_partkey").alias("row_id"), size.alias("width"), dense.alias("x"))
    df = df.withColumns({"back": vocab.ids_of(F.col("x"), 12, F.col("width")), "full": F.array_remove("x", F.lit(0.0).cast("float"))})
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v.cast("long"))
    places = total(F.transform("back", lambda k, t: F.when(k > 0, t * F.col("width") + k).otherwise(0)))
    return df.select("row_id", F.size("x").cast("long").alias("size"), places.alias("places"), total("full").alias("ones"))


@query("select count(*) as n, sum(p_partkey)::bigint as keys, count(distinct p_partkey) as n_keys, 16 as n_batches from part")
def buffered_batches(spark, sf_dir):
    """Sixteen mini-batches through a shuffle buffer: every row is in one of them."""
    df = batches.with_batches(table(spark, sf_dir, "part").select("p_partkey"), 16, 1000)
    return df.agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"), F.countDistinct("p_partkey").alias("n_keys"), F.countDistinct("batch").cast("int").alias("n_batches"))


def _landing(spark, name: str) -> str:
    """A folder for files of a query, where all machines see them."""
    return durable.shared_path(spark, name)


@query("""select p_partkey, translate(lower(p_name), {dev}) as hindi, '"' || p_name || '", ' || p_brand as english, case when p_partkey % 3 = 0 then null else p_type end as kind from part""")
def csv_source(spark, sf_dir):
    """Pairs through a CSV file with a header, quotes and commas; a text for a missing value is null again."""
    path = _landing(spark, "csv")
    quoted = F.concat(F.lit('"'), "p_name", F.lit('", '), "p_brand")
    io.write_csv(table(spark, sf_dir, "part").select("p_partkey", devanagari(F.col("p_name")).alias("hindi"), quoted.alias("english"), F.when(F.col("p_partkey") % 3 == 0, "NaN").otherwise(F.col("p_type")).alias("kind")), path)
    return io.read_csv(spark, path, "p_partkey bigint, hindi string, english string, kind string")


@query(f"select 'plain' as layout, hindi, english, p_partkey as freq from {_PART} union all select 'swapped', hindi, english, null from {_PART}")
def tsv_source(spark, sf_dir):
    """Pairs through files without a header, by place, and through swapped ones."""
    plain, swapped = _landing(spark, "tsv"), _landing(spark, "tsv-swapped")
    df = _part(spark, sf_dir)
    df.select("hindi", "english", "p_partkey").write.option("sep", "\t").option("escape", '"').csv(plain)
    df.select("english", "hindi").write.option("sep", "\t").option("escape", '"').csv(swapped)
    one, two = io.read_tsv(spark, plain), io.read_tsv(spark, swapped, "english string, hindi string")
    return one.select(F.lit("plain").alias("layout"), "hindi", "english", "freq").unionByName(two.select(F.lit("swapped").alias("layout"), "hindi", "english"), allowMissingColumns=True)


@query("select p_partkey as id, translate(lower(p_name), {dev}) as hindi_name, p_name as english_name, p_brand as slug from part")
def json_records(spark, sf_dir):
    """Players through JSON arrays of records; fields that a file lacks are null."""
    path = _landing(spark, "json")
    record = F.struct(F.col("p_partkey").alias("id"), devanagari(F.col("p_name")).alias("hindi_name"), F.col("p_name").alias("english_name"), F.col("p_brand").alias("slug"))
    table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.to_json(F.collect_list(record)).alias("value")).repartition("p_brand", "p_size").write.partitionBy("p_brand", "p_size").text(path)
    return io.read_records(spark, path).filter("gender is null and country_id is null").select("id", "hindi_name", "english_name", "slug")


@query("select o_orderkey as match_id from orders where o_custkey % 50 = 0")
def json_ids(spark, sf_dir):
    """Ids through files that each hold one JSON array."""
    path = _landing(spark, "ids")
    some = table(spark, sf_dir, "orders").filter("o_custkey % 50 = 0")
    some.groupBy("o_orderstatus").agg(F.to_json(F.collect_list("o_orderkey")).alias("value")).repartition("o_orderstatus").write.partitionBy("o_orderstatus").text(path)
    return io.read_ids(spark, path)


@query("select n_nationkey::bigint as unique_id, n_name as name_english, translate(lower(n_name), {dev}) as name_hindi, null::varchar as age from nation")
def affidavit_export(spark, sf_dir):
    """Items through an export in file order; what they lack is empty there and null again."""
    path = _landing(spark, "items")
    io.write_affidavits(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("unique_id"), F.col("n_name").alias("name_english"), devanagari(F.col("n_name")).alias("name_hindi")), path)
    return io.read_affidavits(spark, path).select("unique_id", "name_english", "name_hindi", "age")


@query(f"select ch, n, docs, id from {_VOCAB}")
def tokenizer_json(spark, sf_dir):
    """A vocabulary, a row per character, through a tokenizer file."""
    path = _landing(spark, "tokenizer") + ".json"
    df = _part(spark, sf_dir)
    vocab.write_tokenizer(path, [(r.ch, r.n, r.docs, r.id) for r in vocab.fit_vocab(df, "hindi", "p_partkey").collect()], df.count())
    return vocab.tokenizer_frame(spark, path)


@query(spelling_sql.spelled(_SIGNED_WORDS) + "select count(*) as n, count(*) filter (latin = '' and word <> '') as failed from spelled")
def observed_failures(spark, sf_dir):
    """Predictions and failed ones, as counted by the job that writes the predictions."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(text.split_words(signed(F.col("text")))).alias("word")).distinct()
    df, counts = evaluate.observed(evaluate.with_status(words.withColumn("latin", rules.transliterate(F.col("word"))), "word", "latin"))
    df.write.parquet(_landing(spark, "predictions"))
    return spark.createDataFrame([(counts.get["n"], evaluate.log_failures(counts))], "n long, failed long")


@query(spelling_sql.spelled(_HINDI_WORDS) + f"select p_partkey, levenshtein(latin, english)::double / strlen(english) as rules_edit_distance, levenshtein(translate(hindi, '{LETTERS}', '{LATIN}'), english)::double / strlen(english) as letters_edit_distance from {_PART} join {_TEXTS} using (hindi)")
def compare_backends(spark, sf_dir):
    """Two backends side by side: the rules, and a letter for a letter. Any function from a column to a column is one."""
    found = evaluate.compare_backends(_part(spark, sf_dir), "hindi", "english", {"rules": rules.transliterate, "letters": lambda c: F.translate(c, LETTERS, LATIN)})
    return found.select("p_partkey", "rules_edit_distance", "letters_edit_distance")
