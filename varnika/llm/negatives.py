"""Hard negatives by a vector-approximation file.

Each block of rows is quantised by itself: every dimension has up to 64 cells with edges at its quantiles in the block, and a row is its cell numbers. For
an anchor, a table of what each cell of a dimension adds at least and at most is looked up and summed, which bounds the scores of all rows of the block;
only rows whose bounds may reach a window's list are scored exactly. Positives are searched first (rows of the anchor's label), then, for each positive's
score, the rows of other labels within its window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import keep, tidy

CELLS = 64
LISTS = "anchor long, positive_score long, ids array<long>, scores array<long>"


class Approximation:
    """The cells of a block: codes (rows, dimensions), and the least and greatest number in each cell of each dimension."""

    def __init__(self, data: np.ndarray, cells: int = CELLS):
        n, dim = data.shape
        self.codes = np.zeros((n, dim), np.uint8)
        self.low, self.high = np.zeros((dim, cells)), np.zeros((dim, cells))
        at = (np.arange(1, cells) * n) // cells
        for d in range(dim):
            x = data[:, d]
            edges = np.unique(np.sort(x)[at])
            code = np.searchsorted(edges, x, "right")
            order = np.argsort(x, kind="stable")
            used, start = np.unique(code[order], return_index=True)
            stop = np.append(start[1:], n) - 1
            self.codes[:, d] = code
            self.low[d, used], self.high[d, used] = x[order[start]], x[order[stop]]

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper): bounds of the scores of all rows with each anchor."""
        shape = len(anchors), len(self.codes)
        lower, upper, part = np.zeros(shape), np.zeros(shape), np.empty(shape)
        for d in range(anchors.shape[1]):
            a, b = anchors[:, d, None] * self.low[d], anchors[:, d, None] * self.high[d]
            for total, table in ((lower, np.minimum(a, b)), (upper, np.maximum(a, b))):
                total += np.take(table, self.codes[:, d], axis=1, out=part)
        return lower, upper


def reach(lower: np.ndarray, fit: np.ndarray, k: int) -> float:
    """The k-th greatest lower bound among the rows that fit: what is certainly below it is not among the first k. Without so many, nothing is."""
    some = lower[fit]
    return np.partition(some, len(some) - k)[len(some) - k] if len(some) >= k else -np.inf


class Tile:
    """An anchor group and a block, with bounds for a chunk of anchors at a time."""

    def __init__(self, group: V.Block, block: V.Block):
        self.group, self.block = group, block
        _, code = np.unique(np.concatenate([group.labels, block.labels]).astype(str), return_inverse=True)
        self.label, self.labels = code[: len(group.ids)], code[len(group.ids) :]
        # beyond what doubles hold exactly, bounds are given up: all rows are scored
        self.near = Approximation(block.data) if V.exact(group, block) else None

    def anchors(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, lower, upper) one after the other."""
        for rows in V.chunks(len(self.group.ids), len(self.block.ids)):
            if self.near is None:
                shape = rows.stop - rows.start, len(self.block.ids)
                lower, upper = np.full(shape, -np.inf), np.full(shape, np.inf)
            else:
                lower, upper = self.near.bounds(self.group.reals[rows])
            yield from zip(range(rows.start, rows.stop), lower, upper, strict=True)

    def scored(self, anchor: int, columns: np.ndarray) -> np.ndarray:
        return V.product(self.group, self.block, slice(anchor, anchor + 1), columns)[0]


def _list(out: list, anchor: int, mark: int, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    """Adds the k best of these to out."""
    if len(ids):
        at = np.lexsort((ids, -scores))[:k]
        out.append((anchor, mark, list(ids[at]), list(scores[at])))


def _frame(out: list) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["anchor", "positive_score", "ids", "scores"], dtype=object)


def positives_of_tile(group: V.Block, block: V.Block, k: int) -> Iterator[pd.DataFrame]:
    """The k best rows of each anchor's label, itself left out."""
    tile, out = Tile(group, block), []
    for a, lower, upper in tile.anchors():
        fit = (tile.labels == tile.label[a]) & (block.ids != group.ids[a])
        at = np.flatnonzero(fit & (upper >= reach(lower, fit, k)))
        _list(out, group.ids[a], 0, block.ids[at], tile.scored(a, at), k)
    yield _frame(out)


def negatives_of_tile(group: V.Block, block: V.Block, targets: list, k: int, low: int, high: int) -> Iterator[pd.DataFrame]:
    """For each anchor and score p of a positive, the k best rows of other labels whose score s has low * p <= 100 * s <= high * p."""
    tile, out = Tile(group, block), []
    for a, lower, upper in tile.anchors():
        other = tile.labels != tile.label[a]
        for p in targets[a]:
            p = int(p)
            least, most = -(-low * p // 100), high * p // 100
            fit = other & (upper >= least) & (lower <= most)
            at = np.flatnonzero(fit & (upper >= reach(lower, fit & (lower >= least) & (upper <= most), k)))
            scores = tile.scored(a, at)
            inside = (scores >= least) & (scores <= most)
            _list(out, group.ids[a], p, block.ids[at[inside]], scores[inside], k)
    yield _frame(out)


def _grouped(x: pd.DataFrame) -> pd.DataFrame:
    """vectors._packed with the scores of the anchors' positives, in the order of the ids."""
    return V._packed(x).assign(targets=[list(x.sort_values("id")["targets"])])


@tidy
def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Vectors become floor(scale * x); a score is the inner product with the anchor, higher ones first, ties by smaller key. Anchors are the rows for which is_anchor, a condition on the
    column `id`, holds. An anchor's positives are its first other rows of its label; for each, the first rows of other labels with low * positive <= 100 * score <= high *
    positive are returned (none: no row). Rows of null key or label, and vectors that are null or hold a null or non-finite component, take no part; vectors meet those of their own length
    only; rows that share a key count once (see vectors.whole); scores beyond a long stop at its ends. Other columns are not read; an empty table gives an empty result.
    """
    rows = keep(V.whole(vectors, key, vector, label, scale), "whole")
    blocks, parts = V.packed(rows, V.BLOCK)
    anchors = rows.filter(is_anchor)
    groups, counts = V.packed(anchors, V.GROUP)
    levels = V.most_parts(parts)
    lists = V.tiles(blocks, parts, groups, counts, lambda g, b, _: positives_of_tile(g, b, positives), LISTS)
    found = keep(V.ranked(V.listed(lists, ["anchor"], positives, levels), "anchor").select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score")), "positives")
    goals = found.groupBy(F.col("anchor").alias("_a")).agg(F.array_sort(F.collect_set("positive_score")).alias("targets"))  # no more than `positives`
    sought = anchors.join(goals, F.col("id") == F.col("_a")).drop("_a")
    sought = sought.join(counts.withColumnRenamed("dim", "_d"), F.col("dim") == F.col("_d")).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("parts")).cast("int"))
    groups = keep(sought.groupBy("dim", "part").applyInPandas(_grouped, V.PACKED + ", targets array<array<long>>"), "sought")
    lists = V.tiles(blocks, parts, groups, counts, lambda g, b, x: negatives_of_tile(g, b, x["targets"], negatives, low, high), LISTS, ("targets",))
    top = V.ranked(V.listed(lists, ["anchor", "positive_score"], negatives, levels), "anchor", "positive_score").withColumnsRenamed({"anchor": "_a", "positive_score": "_p"})
    hit = found.join(top, (F.col("anchor") == F.col("_a")) & (F.col("positive_score") == F.col("_p")))
    return hit.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
