"""Preparing (hindi, english) pairs: splitting, union, cleaning, auditing and splits for training."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varnika.functions.text import is_ascii, strip_ws

from .numbering import numbered


def to_pairs(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Several (hindi, english) column pairs of a row as rows, in one scan."""
    rows = [F.struct(F.col(h).alias("hindi"), F.col(e).alias("english")) for h, e in columns]
    return df.select(F.inline(F.array(*rows)))


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources' pairs, matched by column name."""
    return reduce(DataFrame.unionByName, [s.select("hindi", "english") for s in sources])


def clean(pairs: DataFrame, ascii_only: bool = True) -> DataFrame:
    """Drop nulls, strip, lower the target, drop abbreviations and lists, keep distinct pairs with an ASCII target.

    Nulls go before stripping, so a name of white space alone stays as the empty string. All filters run below the one shuffle.
    """
    df = pairs.dropna("any").select(strip_ws(F.col("hindi")).alias("hindi"), F.lower(strip_ws(F.col("english"))).alias("english"))
    df = df.filter(~F.col("english").contains(".") & ~F.col("english").contains(","))
    return (df.filter(is_ascii(F.col("english"))) if ascii_only else df).distinct()


def audit(df: DataFrame, stage: str) -> DataFrame:
    """Row count and non-null count of each column."""
    return df.agg(F.lit(stage).alias("stage"), F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in df.columns]).select("stage", "n_rows", *[f"n_{c}" for c in df.columns])


def info(df: DataFrame) -> DataFrame:
    """One row per column: its place, type, the number of rows and of values that are not null. One pass."""
    found = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_{k}") for k, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(k).alias("place"), F.lit(c).alias("name"), F.lit(kind).alias("dtype"), F.col("_rows").alias("n_rows"), F.col(f"_{k}").alias("n_values")) for k, (c, kind) in enumerate(df.dtypes)]
    return found.select(F.inline(F.array(*rows)))


def zip_lists(df: DataFrame, *lists: str) -> DataFrame:
    """df with a row for each place of parallel lists: their elements in columns of the same names, and the place from 0. The shorter give null."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in lists]
    return df.select(*rest, F.posexplode(F.arrays_zip(*lists)).alias("place", "_z")).select(*rest, "place", *[F.col(f"_z.{c}") for c in lists])


def stable_hash(*parts: Column) -> Column:
    """32 bits of the MD5 of values joined by a bar: the same in every engine, whatever the partitions."""
    return F.conv(F.left(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), F.lit(8)), 16, 10).cast("long")


def hash_split(df: DataFrame, key: str, held_out: int = 5) -> DataFrame:
    """df with is_train: a stable split, by a hash of the key of any type, in which one of `held_out` is left for validation."""
    return df.withColumn("is_train", stable_hash(F.col(key)) % held_out != 0)


def batches(df: DataFrame, order: str, size: int = 64) -> DataFrame:
    """df with a batch number in the given order; an incomplete last batch is dropped."""
    df, total = numbered(df, order, "batch")
    return df.withColumn("batch", F.expr(f"batch div {size}")).filter(F.col("batch") < total // size)


def shuffled(df: DataFrame, key: str, out: str = "place", seed: int = 1) -> DataFrame:
    """df with a place in a seeded random order that depends on the unique key alone."""
    df = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    return numbered(df, "_h", out)[0].drop("_h")


def sample_rows(df: DataFrame, n: int = 10, seed: int = 1) -> DataFrame:
    """n rows at random: those of smallest hash, the same on each run."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(f"`{c}`").cast("string") for c in df.columns]))).limit(n)
