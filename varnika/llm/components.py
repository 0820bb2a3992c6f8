"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep


def _starred(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest of u and its neighbours in `of`. The minima are a table of their own, so that a join can split a hub."""
    least = keep(of.groupBy("u").agg(F.min("v").alias("m")), "minima").select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).drop("_u")


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """From edges (u, v): (node, component) for each node that has an edge to another; component is the smallest node reachable.

    Null ends and loops are left out, repeated edges count once, and no edge gives an empty table.
    A step joins each edge with the minimum around its end, so a hub's edges stay spread over tasks.
    """
    edges = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        ups = edges.select(F.count("*").alias("n"), F.countDistinct("u").alias("d")).first()
        if ups.n == 0 or ups.n == ups.d and edges.alias("a").join(edges.select(F.col("u").alias("_u")), F.col("v") == F.col("_u"), "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = keep(_starred(both.filter("v > u"), both).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        small = _starred(large, large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before, edges = edges, keep(small, "small")
        drop(before)
        drop(large)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
