"""Sharding by longest-processing-time scheduling of groups that must stay together.

Equal texts form a group, whose size is the sum over its rows. Groups go by falling size to the least-loaded shard, ties
to the lowest. Groups of equal size are interchangeable, so the driver only sees how many groups there are of each size, and a
plan row says how many of them each shard gets. The sizes pass the driver in falling order, a bounded number at a time, and
only the loads of the shards stay there.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, prefix_sum, table_path, tidy

#: More equal groups than this are placed by one search for the load level they reach.
ONE_BY_ONE = 64
#: Plan rows that the driver holds at once.
PART = 100_000


def place(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` equal groups each shard gets, the next always to the least-loaded shard (lowest first). Adds them to loads."""
    got = [0] * len(loads)
    if count <= ONE_BY_ONE or size == 0:
        heap = [(load, k) for k, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count if size else 0):
            load, k = heap[0]
            got[k] += 1
            heapq.heapreplace(heap, (load + size, k))
        if not size:
            got[0] = count
    else:
        below = lambda level: [max(0, -(-(level - load) // size)) for load in loads]
        lo, hi = min(loads), max(loads) + size * (count + 1)
        while lo < hi:  # the highest level that takes no more than count
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if sum(below(mid)) <= count else (lo, mid - 1)
        got = below(lo)
        for k, load in enumerate(loads):
            if sum(got) < count and load + got[k] * size == lo:
                got[k] += 1
    for k, n in enumerate(got):
        loads[k] += n * size
    return got


def schedule(counts: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """From (size, number of groups) by falling size: for each size, the first rank of each shard among the groups of that size."""
    loads = [0] * shards
    for size, count in counts:
        bounds, at = [], 0
        for n in place(loads, size, count):
            bounds.append(at)
            at += n
        yield size, bounds


def _planned(sizes: DataFrame, shards: int) -> DataFrame:
    """schedule() of (size, number) rows as a table (_size, _bounds), written part by part."""
    spark = sizes.sparkSession
    path, schema = table_path(spark, "plan"), "_size long, _bounds array<long>"
    spark.createDataFrame([], schema).write.parquet(path)
    rows = schedule(((r[0], r[1]) for r in sizes.toLocalIterator()), shards)
    while part := list(itertools.islice(rows, PART)):
        spark.createDataFrame(part, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


@tidy
def shard(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = 8) -> DataFrame:
    """key, size, text_crc32, shard and slot for every row.

    size is the text's UTF-8 bytes plus 1. Null text has no byte and is in the group of the empty text. Repeated rows and null keys are
    rows like any other. slot counts the rows of a shard from 0 without gaps. Very long texts are
    hashed whole; other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.md5(t.cast("binary"))).alias("_group"))
    rows = keep(rows, "rows")
    groups = keep(rows.groupBy("_group").agg(F.sum("size").alias("_bytes")), "groups")
    sizes = keep(groups.groupBy("_bytes").count(), "sizes")
    plan = _planned(sizes.orderBy(F.desc("_bytes")), shards)
    ranked = prefix_sum(groups, ["_bytes"], ["_group"], None, "_rank", groups.count())
    where = F.array_size(F.filter("_bounds", lambda b: b <= F.col("_rank"))) - 1
    placed = keep(ranked.join(plan, F.col("_bytes") == F.col("_size")).select(F.col("_group").alias("_g"), where.cast("int").alias("shard")), "placed")
    rows = keep(rows.join(placed, F.col("_group") == F.col("_g")).select("_key", "size", "text_crc32", "_group", "shard"), "sharded")
    rows = prefix_sum(rows, ["shard"], ["_key", "_group"], None, "slot", rows.count())
    return rows.select(F.col("_key").alias(key), "size", "text_crc32", "shard", "slot")
