"""Exact top-k search by tiled matrix products: partial selection in each tile, and a tree that merges the lists of each query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import keep, tidy

LISTS = "query long, ids array<long>, scores array<long>"


def best_of_tile(group: V.Block, block: V.Block, k: int) -> Iterator[pd.DataFrame]:
    """The k best of the block for each query of the group, its own row left out."""
    for rows in V.chunks(len(group.ids), len(block.ids)):
        scores = V.product(group, block, rows)
        other = group.ids[rows, None] != block.ids[None, :]
        at, column = V.first(scores, k, other)
        found, (ids, best) = V.lists(at, block.ids[column], scores[at, column])
        yield pd.DataFrame({"query": group.ids[rows][found], "ids": ids, "scores": best})


@tidy
def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: the k candidates of highest score for each query, ties by smaller vec_id.

    Vectors become floor(scale * x); the score is their inner product. Queries are the rows for which is_query, a condition on the column `id`, holds. Candidates are all rows but
    the query's own. Vectors that are null or hold a null or non-finite component, and rows of null key, take no part; vectors meet those of their own length only; rows that share a
    key count once (see vectors.whole). Scores beyond a long stop at its ends. Other columns are not read; an empty table gives an empty result.
    """
    rows = keep(V.whole(vectors, key, vector, scale=scale), "whole")
    blocks, parts = V.packed(rows, V.BLOCK)
    groups, counts = V.packed(rows.filter(is_query), V.GROUP)
    lists = V.tiles(blocks, parts, groups, counts, lambda g, b, _: best_of_tile(g, b, k), LISTS)
    top = V.listed(lists, ["query"], k, V.most_parts(parts))
    return V.ranked(top, "query").select(F.col("query").alias("query_id"), "rank", F.col("id").alias(key), "score")
