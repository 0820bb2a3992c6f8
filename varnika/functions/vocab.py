"""Character vocabularies: fitting, encoding, padding, shifting and decoding as Column and DataFrame functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import chars


def char_rows(df: DataFrame, text: str, row_id: str, lower: bool = True) -> DataFrame:
    """(row_id, pos, ch): one row per code point, positions from 0."""
    c = F.lower(text) if lower else F.col(text)
    return df.select(F.col(row_id).alias("row_id"), F.posexplode(chars(c)).alias("pos", "ch"))


def fit_vocab(df: DataFrame, text: str, row_id: str, lower: bool = True) -> DataFrame:
    """(ch, n, docs, id): ids from 1 by falling count; ties by first place (row_id, position). row_id is unique. One row per character is ranked."""
    c = F.lower(text) if lower else F.col(text)
    rows = df.select(F.col(row_id).alias("row_id"), chars(c).alias("_c"))
    # what a row knows alone is counted in it, so that one shuffle carries a row per character and task
    each = F.transform(F.array_distinct("_c"), lambda x: F.struct(x.alias("ch"), F.size(F.filter("_c", lambda y: y == x)).alias("n"), (F.array_position("_c", x) - 1).alias("pos")))
    per_row = rows.select("row_id", F.inline(each))
    place = F.struct("row_id", "pos")
    if dict(rows.dtypes)["row_id"] in ("tinyint", "smallint", "int", "bigint"):
        # as one number: Spark hashes to find the least number, but sorts all rows of a task for the least struct
        place = F.col("row_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    counts = per_row.groupBy("ch").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.min(place).alias("first"))
    return counts.select("ch", "n", "docs", F.row_number().over(Window.orderBy(F.desc("n"), F.asc_nulls_last("first"))).cast("long").alias("id"))


def alphabet(df: DataFrame, text: str) -> DataFrame:
    """(ch, id): ids from 0 in code-point order."""
    rows = df.select(F.explode(chars(F.col(text))).alias("ch")).distinct()
    return rows.select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).cast("long").alias("id"))


def as_map(vocab: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in vocab.items() for x in pair]) if vocab else F.create_map().cast("map<string,int>")


def encode(c: Column, vocab: Column, skip_unknown: bool = False) -> Column:
    """Character ids. A character out of the vocabulary makes the whole result null, or is skipped (as in training). Case counts."""
    ids = F.transform(chars(c), lambda x: F.try_element_at(vocab, x))
    return F.filter(ids, lambda x: x.isNotNull()) if skip_unknown else F.when(~F.exists(ids, lambda x: x.isNull()), ids)


def pad(ids: Column, n: int) -> Column:
    """Exactly n ids: the last n of a longer array, zeros after a shorter one."""
    size = F.size(ids)
    tail = F.slice(ids, F.greatest(size - n + 1, F.lit(1)), F.lit(n))
    return F.when(ids.isNotNull(), F.concat(tail, F.array_repeat(F.lit(0), F.greatest(n - size, F.lit(0)))))


def decode(ids: Column, letters: Column) -> Column:
    """Text of ids (letters: array with the character of id 1 first); 0 is skipped."""
    return F.array_join(F.transform(F.filter(ids, lambda x: x != 0), lambda x: F.try_element_at(letters, x)), "")


def teacher_pair(ids: Column) -> Column:
    """Decoder input (all but the last) and target (all but the first)."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.struct(F.slice(ids, F.lit(1), n).alias("input"), F.slice(ids, F.lit(2), n).alias("target"))


def tile(ids: Column, times: int = 1) -> Column:
    """The ids so many times over."""
    return F.flatten(F.array_repeat(ids, times))


def shifted_one_hot(df: DataFrame, ids: str, row_id: str) -> DataFrame:
    """(row_id, t, idx): the places of ones of the target one step ahead."""
    return one_hot(df.withColumn(ids, teacher_pair(F.col(ids))["target"]), ids, row_id)


def one_hot(df: DataFrame, ids: str, row_id: str) -> DataFrame:
    """(row_id, t, idx): the places of ones, instead of a dense cube."""
    return df.select(F.col(row_id).alias("row_id"), F.posexplode(ids).alias("t", "idx"))


def dense_one_hot(ids: Column, steps: int, size: Column | int) -> Column:
    """steps * size floats, step by step, with a 1 at the id of each step: a dense tensor, flattened. An id of 0 (padding), beyond the size or missing gives zeros."""
    size = F.lit(size) if isinstance(size, int) else size
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n.cast("int"))
    # a step is three runs of floats, not an expression for each float
    row = lambda k: F.when((k > 0) & (k < size), F.concat(zeros(k), F.array(F.lit(1.0).cast("float")), zeros(size - k - 1))).otherwise(zeros(size))
    first = F.slice(F.concat(ids, F.array_repeat(F.lit(None), steps)), 1, steps)
    return F.flatten(F.transform(first, row))


def sparse_one_hot(ids: Column, steps: int, size: int) -> Column:
    """The same as a sparse vector for pyspark.ml, from the ids alone; its type has no expression that makes it, so Python does."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    def made(found):
        if found is None:
            return None
        return Vectors.sparse(steps * size, [(t * size + k, 1.0) for t, k in enumerate(found[:steps]) if k is not None and 0 < k < size])

    return F.udf(made, VectorUDT())(ids)


def dense_of(vector: Column) -> Column:
    """The floats of a vector of either kind; null for null."""
    from pyspark.ml.functions import vector_to_array

    return F.when(vector.isNotNull(), vector_to_array(vector, "float32"))


def ids_of(dense: Column, steps: int, size: Column | int) -> Column:
    """The ids of a dense tensor, 0 where a step has no 1."""
    step = lambda t: F.slice(dense, t * size + 1, F.lit(size))
    found = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda t: F.greatest(F.array_position(step(t), F.lit(1.0).cast("float")) - 1, F.lit(0)).cast("int"))
    return F.when(dense.isNotNull(), found)


def _system(path: str):
    """(pyarrow file system, path) of an address, or of a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_tokenizer(path: str) -> dict:
    """A tokenizer JSON, decoded as often as it was encoded: the file, its config, and the maps within. path may be the address of a file system that all machines share."""
    system, where = _system(path)
    with system.open_input_stream(where) as f:
        data = json.loads(f.read().decode("utf-8"))
    data = json.loads(data) if isinstance(data, str) else data
    config = data["config"]
    return config | {k: json.loads(v) for k, v in config.items() if isinstance(v, str) and k in ("word_counts", "word_docs", "index_docs", "index_word", "word_index")}


def tokenizer_frame(spark: SparkSession, path: str) -> DataFrame:
    """(ch, id, n, docs) of a tokenizer JSON: one row per character."""
    t = read_tokenizer(path)
    rows = [(c, i, t["word_counts"].get(c), t["word_docs"].get(c)) for c, i in t["word_index"].items()]
    return spark.createDataFrame(rows, "ch string, id long, n long, docs long")


def write_tokenizer(path: str, vocab: list[tuple[str, int, int, int]], documents: int) -> None:
    """(ch, n, docs, id) rows as a tokenizer JSON of the same nesting."""
    inner = {
        "word_counts": {c: n for c, n, _, _ in vocab}, "word_docs": {c: d for c, _, d, _ in vocab}, "index_docs": {str(i): d for _, _, d, i in vocab},
        "index_word": {str(i): c for c, _, _, i in vocab}, "word_index": {c: i for c, _, _, i in vocab},
    }
    config = {"num_words": None, "filters": "", "lower": True, "split": " ", "char_level": True, "oov_token": None, "document_count": documents}
    system, where = _system(path)
    with system.open_output_stream(where) as f:
        f.write(json.dumps(json.dumps({"class_name": "Tokenizer", "config": config | {k: json.dumps(v) for k, v in inner.items()}})).encode("utf-8"))
