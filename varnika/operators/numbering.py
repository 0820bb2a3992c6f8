"""Numbers and running values for all rows of a table in an order, without bringing a table or a key's rows into one task.

Rows are dealt to partitions by ranges of the order, whose bounds Spark samples; the partition's number is kept with each row in a durable table, as
another run of the job might draw other bounds. What a partition adds up to is one row, and rows are moved on by what stands before their partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import keep, tidy

#: Rows of a partition, and the least number of partitions.
ROWS, LEAST = 200_000, 8


def _parts(total: int, rows: int) -> int:
    return max(LEAST, -(-total // rows))


def numbered(df: DataFrame, order: str, out: str, start: int = 0, rows: int = ROWS) -> tuple[DataFrame, int]:
    """(df with out, the number of rows): rows numbered from `start` by a column, nulls first; rows of equal values in any order.

    One shuffle into partitions of about `rows` rows, sorted; a row's number is its place in its partition and the rows of the partitions before. Only counts of partitions reach the driver.
    """
    by = F.col(order).asc_nulls_first()
    total = df.count()
    dealt = df.repartitionByRange(_parts(total, rows), by).sortWithinPartitions(by)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the part of the id that counts within a partition
    dealt = keep(dealt.select("*", F.spark_partition_id().alias("_part"), place.alias("_place")), "numbered")
    at, ahead = start, []
    for part, n in sorted(dealt.groupBy("_part").count().collect()):
        ahead.append((part, at))
        at += n
    offsets = df.sparkSession.createDataFrame(ahead, "_of int, _ahead long")
    placed = dealt.join(F.broadcast(offsets), F.col("_part") == F.col("_of"))  # a row per partition
    return placed.withColumn(out, F.col("_place") + F.col("_ahead")).drop("_part", "_place", "_of", "_ahead"), total


def _ranged(df: DataFrame, by: list[str], order: list[str], rows: int) -> DataFrame:
    """df in a durable table, with `_part`: ranges of (by, order) of about `rows` rows, so a frequent key is spread over several."""
    keys = [*by, *order]
    return keep(df.repartitionByRange(_parts(df.count(), rows), *keys).withColumn("_part", F.spark_partition_id()), "ranged")


def running(df: DataFrame, by: list[str], order: list[str], rows: int = ROWS, **values: tuple[str, Column]) -> DataFrame:
    """df with a column for each of `values`, out = (kind, column): the sum, min, max or count ("sum", ...) of the column over the rows of equal `by` up to and with each row.

    As a window over by and order gives them, but no key is one task's. order must tell the rows of a key apart. Null keys are a key.
    """
    return _run(_ranged(df, by, order, rows), by, order, values).drop("_part")


def _run(ranged: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], exclusive: tuple[str, ...] = ()) -> DataFrame:
    """running() over a table of _ranged(), whose _part stays. Those in `exclusive` leave the row itself out."""
    add = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    both = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "min": F.least, "max": F.greatest, "count": lambda a, b: F.coalesce(a, F.lit(0).cast("long")) + F.coalesce(b, F.lit(0).cast("long"))}
    merge = {"count": F.sum}
    w = Window.partitionBy(*by, "_part").orderBy(*order)
    frame = lambda out: w.rowsBetween(Window.unboundedPreceding, -1 if out in exclusive else Window.currentRow)
    inner = ranged.select("*", *[add[kind](c).over(frame(out)).alias(f"_in_{out}") for out, (kind, c) in values.items()])
    totals = ranged.groupBy(*by, "_part").agg(*[add[kind](c).alias(f"_all_{out}") for out, (kind, c) in values.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)], F.col("_part").alias("_at"), *[merge.get(kind, add[kind])(f"_all_{out}").over(before).alias(f"_pre_{out}") for out, (kind, _) in values.items()])
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_by{i}"))
    joined = inner.join(totals, same)
    made = {out: both[kind](F.col(f"_pre_{out}"), F.col(f"_in_{out}")) for out, (kind, _) in values.items()}
    return joined.select(*[F.col(c) for c in ranged.columns], *[c.alias(out) for out, c in made.items()])


@tidy
def best_so_far(df: DataFrame, by: list[str], order: list[str], loss: str, rows: int = ROWS) -> DataFrame:
    """df with `best`, the smallest loss up to each row of its run, and `patience`, the rows since that was first reached. order must tell the rows of a run apart."""
    state = _run(_ranged(df, by, order, rows), by, order, {"_earlier": ("min", F.col(loss)), "_place": ("count", F.lit(1))}, ("_earlier",))
    better = F.coalesce(F.col(loss) < F.col("_earlier"), F.col("_earlier").isNull() & (F.col(loss).isNotNull() | (F.col("_place") == 1)))
    state = _run(keep(state, "best"), by, order, {"_since": ("max", F.when(better, F.col("_place")))})
    return state.withColumns({"best": F.least("_earlier", loss), "patience": F.col("_place") - F.col("_since")}).drop("_part", "_earlier", "_place", "_since")
