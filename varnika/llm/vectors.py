"""Whole-number vectors in tiles: blocks of rows meet groups of queries, each tile gives short lists, and lists are merged in a tree.

Every row is in one block and every query in one group, both of bounded bytes. A tile (one block, one group) is a row of a join by tile
number, so any number of tiles spreads over the machines, none is larger than a block and a group together, and a lost one is computed again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, keep

#: Rows of a block and queries of a group at most, and numbers in either; as many blocks as that are made of a smaller table, so that machines share it.
BLOCK, GROUP, NUMBERS, SPREAD = 65_536, 8_192, 1 << 22, 48
#: Scores that a tile computes at once.
AT_ONCE = 1 << 21
#: Lists that one step of the tree merges.
FAN = 32
TOP = np.iinfo(np.int64).max


def whole(vectors: DataFrame, key: str, vector: str, label: str | None = None, scale: int = 256) -> DataFrame:
    """(id, dim, label, vec): floor(scale * x) of each component, for rows that take part.

    Rows with a null key, a null vector or a null or non-finite component don't, nor, if label is given, those of null label. Numbers stop at the ends of a long.
    Rows that share a key count once, with the smallest label and then the smallest vector.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.filter(fine & F.col(key).isNotNull() & (F.lit(True) if label is None else F.col(label).isNotNull()))
    name = F.lit("") if label is None else F.col(label)
    cells = F.transform(v, lambda c: F.floor(F.greatest(F.least(F.lit(float(scale)) * c, F.lit(9.3e18)), F.lit(-9.3e18))).cast("long"))
    rows = rows.select(F.col(key).cast("long").alias("id"), F.struct(name.alias("label"), cells.alias("vec")).alias("x"))
    one = rows.groupBy("id").agg(F.min("x").alias("x"))
    return one.select("id", F.size("x.vec").alias("dim"), F.col("x.label").cast("string").alias("label"), F.col("x.vec").alias("vec"))


def _packed(x: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: ids in order, labels, and the numbers in the narrowest type."""
    x = x.sort_values("id")
    dim = int(x["dim"].iloc[0])
    data = np.array([np.asarray(v, np.int64) for v in x["vec"]], np.int64).reshape(len(x), dim)
    kind = next(k for k in ("<i2", "<i4", "<i8") if not data.size or np.iinfo(k).min <= data.min() and data.max() <= np.iinfo(k).max)
    return pd.DataFrame({"dim": [dim], "part": [int(x["part"].iloc[0])], "ids": [x["id"].to_numpy("<i8").tobytes()], "labels": [list(x["label"])], "kind": [kind], "data": [data.astype(kind).tobytes()]})


PACKED = "dim int, part int, ids binary, labels array<string>, kind string, data binary"


def packed(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, counts): the rows dealt by a hash of their id into blocks of about `most` at the largest, and (dim, parts) for each length of vector."""
    n = F.count("*")
    room = F.greatest(F.lit(1), F.least(F.lit(float(most)), F.lit(float(NUMBERS)) / F.greatest("dim", F.lit(1)), F.greatest(F.ceil(n / SPREAD), F.lit(256.0))))
    counts = keep(rows.groupBy("dim").agg(F.ceil(n / room).cast("int").alias("parts")), "counts")
    dealt = rows.join(counts.withColumnRenamed("dim", "_dim"), F.col("dim") == F.col("_dim")).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("parts")).cast("int"))
    return keep(dealt.groupBy("dim", "part").applyInPandas(_packed, PACKED), "blocks"), counts


class Block:
    """A block or group unpacked."""

    def __init__(self, dim: int, ids: bytes, labels: list[str], kind: str, data: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.labels = np.asarray(labels, object)
        self.data = np.frombuffer(data, kind).astype(np.int64).reshape(len(self.ids), dim)
        self.most = max(abs(int(self.data.min(initial=0))), abs(int(self.data.max(initial=0))))

    @functools.cached_property
    def reals(self) -> np.ndarray:
        return self.data.astype(np.float64)


def exact(a: Block, b: Block) -> bool:
    """Whether all scores of the two are whole numbers that a double holds."""
    return a.most * b.most * max(1, a.data.shape[1]) < 1 << 53


def product(a: Block, b: Block, rows: slice | np.ndarray, columns: slice | np.ndarray = slice(None)) -> np.ndarray:
    """The scores of these rows of a with these of b, as a long each; scores beyond a long stop at its ends."""
    if exact(a, b):
        return (a.reals[rows] @ b.reals[columns].T).astype(np.int64)
    return np.clip(a.data[rows].astype(object) @ b.data[columns].T.astype(object), -TOP, TOP).astype(np.int64)


def first(scores: np.ndarray, k: int, fit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each row, among those that fit; equal ones by column. No more than k a row, however many are equal."""
    if fit is not None:
        scores = np.where(fit, scores, -TOP - 1)
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k, None]
        above, equal = scores > least, scores == least
        taken = above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))
    else:
        taken = np.ones(scores.shape, bool)
    if fit is not None:
        taken &= fit
    return np.nonzero(taken)


def lists(at: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pd.Series]]:
    """From rising row numbers and columns of values: the rows that occur, and each column's values as a list for each."""
    rows, start = np.unique(at, return_index=True)
    return rows, [pd.Series([list(x) for x in np.split(c, start[1:])] if len(rows) else [], dtype=object) for c in columns]


def tiles(blocks: DataFrame, parts: DataFrame, groups: DataFrame, counts: DataFrame, f: Callable[[Block, Block, dict], Iterator[pd.DataFrame]], schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """f(group, block, extra columns of the group) of every tile: vectors of a length meet.

    blocks and groups come from packed(), parts and counts are theirs. The hint keeps Catalyst, which doesn't know how many tiles a row joins, from broadcasting either side.
    """
    other = lambda df, name: df.select(F.col("dim").alias("_d"), F.col("parts").alias(name))
    spread = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1)).alias("other")
    left = blocks.join(other(counts, "_n"), F.col("dim") == F.col("_d")).select(*[F.col(c).alias(f"b_{c}") for c in blocks.columns], spread("_n"))
    right = groups.join(other(parts, "_n"), F.col("dim") == F.col("_d")).select(*groups.columns, spread("_n"))
    met = left.join(right.hint("merge"), (F.col("b_dim") == F.col("dim")) & (F.col("b_part") == right["other"]) & (left["other"] == F.col("part")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.to_dict("records"):
                block = Block(x["b_dim"], x["b_ids"], x["b_labels"], x["b_kind"], x["b_data"])
                group = Block(x["dim"], x["ids"], x["labels"], x["kind"], x["data"])
                for out in f(group, block, x):
                    yield out.assign(part=x["b_part"])

    wanted = ["ids", "labels", "kind", "data"]
    with arrow_batches(blocks.sparkSession, 1):
        return keep(met.select("b_dim", "b_part", *[f"b_{c}" for c in wanted], "dim", *wanted, *more).mapInPandas(run, schema + ", part int"), "tiles")


def listed(lists: DataFrame, by: list[str], k: int, parts: int) -> DataFrame:
    """(by, top): the k best (lack, id) of each, from one list (ids, scores) per tile, merged FAN at a time. lack is the negative score, so that order is by score and then by id."""
    best = lambda c: F.slice(F.array_sort(c), 1, k)
    top = F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct((-x["scores"]).alias("lack"), x["ids"].alias("id")))
    state, left = lists.select(*by, "part", best(top).alias("top")), max(1, parts)
    while left > 1:
        left = -(-left // FAN)
        state = state.groupBy(*by, F.floor(F.col("part") / FAN).cast("int").alias("part")).agg(best(F.flatten(F.collect_list("top"))).alias("top"))
    return state.select(*by, "top")


def ranked(lists: DataFrame, *columns: str | Column, rank: str = "rank") -> DataFrame:
    """A row per entry of listed(): columns, rank from 1, and `id` and `score`."""
    x = lists.select(*columns, F.posexplode("top").alias("_at", "_x"))
    return x.withColumns({rank: (F.col("_at") + 1).cast("int"), "id": F.col("_x.id"), "score": -F.col("_x.lack")}).drop("_at", "_x")


def chunks(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows with about AT_ONCE numbers of a given width each."""
    step = max(1, AT_ONCE // max(1, width))
    return (slice(i, min(n, i + step)) for i in range(0, n, step))


def most_parts(counts: DataFrame) -> int:
    return counts.agg(F.max("parts")).first()[0] or 1
