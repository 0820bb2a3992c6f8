"""Helpers that the operators share: distributed prefix sums, word patterns, Arrow settings, and the durable tables of varnika.operators.durable."""

from __future__ import annotations

import contextlib
import math
import threading

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varnika.operators.durable import drop, keep, remove, shared_dir, shared_path, table_path, tables_made, tidy  # noqa: F401

#: ASCII white space separates words; all else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, for use inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: str | None, out: str, rows: int, per_bucket: int | None = None) -> DataFrame:
    """Add out: the sum of value (None: the count) over the rows before each row, separately for each combination of keys.

    Rows are dealt into hash buckets of about per_bucket rows (default: the square root of rows, so that buckets and totals grow
    alike; 1,000 at least) by the order columns, summed within their
    bucket, and moved up by the totals of the buckets before theirs. No key, however frequent, meets in one task;
    only one row per key and bucket does. The order is by bucket and then by the order columns: the same on each
    run. Rows with equal order columns must be interchangeable. df should be cheap to read twice (see keep()).
    """
    buckets = max(1, -(-rows // (per_bucket or max(1_000, math.isqrt(rows)))))
    amount = F.lit(1).cast("long") if value is None else F.coalesce(F.col(value), F.lit(0)).cast("long")
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(17), *order), F.lit(buckets)).cast("int")).withColumn("_amount", amount)
    dealt = [*keys, "_bucket"]
    w = Window.partitionBy(*dealt).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = df.withColumn("_inner", F.sum("_amount").over(w) - F.col("_amount"))
    total = df.groupBy(*dealt).agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = total.withColumn("_before", F.sum("_total").over(before) - F.col("_total"))
    total = total.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(dealt)], "_before")
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(dealt)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return inner.join(total, cond, "left").withColumn(out, F.col("_inner") + F.col("_before")).drop("_inner", "_before", "_amount", "_bucket", *[f"_k{i}" for i in range(len(dealt))])


_batches: dict[int, tuple[dict, list[tuple[int, int]]]] = {}
_settings = threading.Lock()
UNITS = {"k": 1 << 10, "m": 1 << 20}


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: str = "4m"):
    """While this holds, Python functions get at most so many rows and about so many bytes at once (one row at least). Jobs must run inside.

    Settings belong to the session: of several threads inside, the smallest rows and bytes hold, and when the last one leaves, what was set before the first.
    """
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    mine = rows, int(size[:-1]) * UNITS[size[-1]]

    def settle(active: list[tuple[int, int]]) -> None:
        for name, values in zip(names, zip(*active, strict=True), strict=True):
            spark.conf.set(name, str(min(values)))

    with _settings:
        _, active = _batches.setdefault(id(spark), ({name: spark.conf.get(name, None) for name in names}, []))
        active.append(mine)
        settle(active)
    try:
        yield
    finally:
        with _settings:
            active.remove(mine)
            if active:
                settle(active)
            else:
                before, _ = _batches.pop(id(spark))
                for name, v in before.items():
                    spark.conf.set(name, v) if v is not None else spark.conf.unset(name)


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file that all machines see; a bare path is a shared mount."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
