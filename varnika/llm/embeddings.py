"""Near-duplicate vectors by a random-projection tree forest.

Equal vectors of a label form a class first. In each tree, a node of too many classes is split at quantiles of random projections
(fitted on a bounded sample of the node); both sides keep what lies between the two quantiles around the median (spill). A cut is never
narrower than linked vectors project apart, so it goes beside dense groups, and a part that it wouldn't make smaller stays whole. Only
classes of one leaf are compared, in double precision. A pair that meets in several leaves counts in the one of lowest id, so links are
counted without ever listing them; each leaf gives the edges of a spanning forest of its links, which are then unified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, tidy
from .components import connected_components

TREES, LEAF, SPILL, SAMPLE = 12, 48, 0.05, 4096
#: Classes of a leaf above its limit (a dense part) that are compared at once.
CHUNK = 1024
#: Width of a cut, in distances of the farthest linked unit vectors: at 1.25, a cut parts few of the links that it meets. Share of a
#: part's pairs that both sides together may keep.
REACH, WORTH = 1.25, 0.85
#: Splits of the forest; what is above a chunk after them is compared in pairs of chunks.
ROUNDS = 6
ROWS = "tree int, node long, cid long, cnt long, vec array<double>"


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _directions(tree: int, node: int, depth: int, size: int) -> np.ndarray:
    return np.random.default_rng([tree, node & 0x7FFFFFFFFFFFFFFF]).standard_normal((size, depth))


def _child(node: int, path: int) -> int:
    """The id of a node's descendant; a scramble of both, below 2**63."""
    x = (node * 0x9E3779B97F4A7C15 + path * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & ((1 << 64) - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
    return (x ^ (x >> 31)) >> 1


def cut(p: np.ndarray, spill: float, reach: float) -> tuple[float, float]:
    """(lo, hi) between the sides of a part with projections p, or (inf, inf) if it stays whole (all go left).

    The quantiles 0.5 - spill and 0.5 + spill, if `reach` apart. Where rows are denser, those would part many links: there the cut is
    `reach` wide and lies where the sides have the fewest pairs, and none is made that leaves over WORTH of the pairs.
    """
    lo, hi = np.quantile(p, [0.5 - spill, 0.5 + spill])
    if hi - lo >= reach:
        return lo, hi
    p = np.sort(p)
    lo = np.quantile(p, np.linspace(0, 1, 101)) - reach / 2
    left, right = np.searchsorted(p, lo + reach, "right") / len(p), 1 - np.searchsorted(p, lo, "right") / len(p)
    pairs = left * left + right * right
    best = int(pairs.argmin())
    return (lo[best], lo[best] + reach) if pairs[best] <= WORTH else (np.inf, np.inf)


def fit(sample: np.ndarray, directions: np.ndarray, spill: float, reach: float) -> np.ndarray:
    """Cuts (lo, hi) of each inner node, in heap order."""
    depth = directions.shape[1]
    cuts, parts = np.zeros((2**depth - 1, 2)), {0: np.arange(len(sample))}
    for level in range(depth):
        p = sample @ directions[:, level]
        for k in range(2**level - 1, 2 ** (level + 1) - 1):
            mine = parts.pop(k)
            lo, hi = cut(p[mine], spill, reach) if len(mine) else (np.inf, np.inf)
            cuts[k] = lo, hi
            parts[2 * k + 1], parts[2 * k + 2] = mine[p[mine] <= hi], mine[p[mine] > lo]
    return cuts


def route(units: np.ndarray, directions: np.ndarray, cuts: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The rows in each leaf, as (path, rows); a row between the cuts goes both ways."""
    p, parts = units @ directions, {0: np.arange(len(units))}
    for level in range(directions.shape[1]):
        for k in range(2**level - 1, 2 ** (level + 1) - 1):
            mine = parts.pop(k)
            lo, hi = cuts[k]
            parts[2 * k + 1], parts[2 * k + 2] = mine[p[mine, level] <= hi], mine[p[mine, level] > lo]
    return [(k, rows) for k, rows in parts.items() if len(rows)]


def _split(rows: DataFrame, sizes: DataFrame, leaf: int, reach: float) -> DataFrame:
    """rows with each node of over `leaf` rows replaced by the leaves of a tree fitted on about SAMPLE of its rows."""
    big = keep(sizes.filter(F.col("n") > leaf).select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "n"), "big")
    same = (F.col("tree") == F.col("_t")) & (F.col("node") == F.col("_n"))
    share = F.pmod(F.xxhash64("cid", "node"), F.lit(1 << 20)) * F.col("n") < F.lit(SAMPLE * (1 << 20))
    sample = rows.join(big, same).filter(share).select("tree", "node", "n", "vec")

    def fitted(x: pd.DataFrame) -> pd.DataFrame:
        tree, node, n = (int(x[c].iloc[0]) for c in ("tree", "node", "n"))
        depth = max(1, min(math.ceil(math.log(n / (0.7 * leaf)) / math.log(1 / (0.5 + SPILL))), int(math.log2(max(2, len(x) / 16)))))
        units = _units(x["vec"])
        cuts = fit(units, _directions(tree, node, depth, units.shape[1]), SPILL, reach)
        return pd.DataFrame({"_t": [tree], "_n": [node], "depth": [depth], "cuts": [cuts.ravel()]})

    models = keep(sample.groupBy("tree", "node").applyInPandas(fitted, "_t int, _n long, depth int, cuts array<double>"), "models")

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for (tree, node), mine in batch.groupby(["tree", "node"]).indices.items():
                x = batch.iloc[mine]
                units = _units(x["vec"])
                d = _directions(int(tree), int(node), int(x["depth"].iloc[0]), units.shape[1])
                for path, part in route(units, d, np.reshape(x["cuts"].iloc[0], (-1, 2))):
                    at.append(mine[part])
                    nodes.append(np.full(len(part), _child(int(node), path)))
            # one frame for all leaves: a batch holds few rows of each, and a frame costs more than they do
            yield batch[["tree", "cid", "cnt", "vec"]].iloc[np.concatenate(at)].assign(node=np.concatenate(nodes))[["tree", "node", "cid", "cnt", "vec"]]

    small = rows.join(big, same, "left_anti")
    return small.unionByName(rows.join(models, same).mapInPandas(routed, ROWS))


def _compared(x: pd.DataFrame, least: float) -> pd.DataFrame:
    """Of one leaf, or one pair of its chunks: (cid, other, links): counts of links that belong to this leaf, and edges to a local root."""
    none = pd.DataFrame({"cid": [], "other": [], "links": []}).astype("int64")
    i, j, leaf = int(x["i"].iloc[0]), int(x["j"].iloc[0]), int(x["node"].iloc[0])
    x = x.drop_duplicates("cid")
    unit, chunk = _units(x["vec"]), x["chunk"].to_numpy()
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    if i != j:
        near &= chunk[:, None] != chunk[None, :]
    some = near.any(axis=1)
    if not some.any():
        return none
    near, x = near[np.ix_(some, some)], x[some]
    cid, cnt = x["cid"].to_numpy(), x["cnt"].to_numpy()
    earlier = [[n for n in nodes if n < leaf] for nodes in x["nodes"]]
    place: dict[int, int] = {}
    for nodes in earlier:
        for n in nodes:
            place.setdefault(n, len(place))
    own = near
    if place:
        held = np.zeros((len(x), len(place)), np.float32)
        for row, nodes in enumerate(earlier):
            held[row, [place[n] for n in nodes]] = 1
        own = near & ~(held @ held.T > 0)
    label = np.arange(len(x))
    while True:  # the smallest row reachable
        lower = np.minimum(label, np.where(near, label[None, :], len(label)).min(axis=1))
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    return pd.DataFrame({"cid": cid, "other": cid[label], "links": own @ cnt})


@tidy
def linked(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """key, n_links and component_id for every row.

    Rows are compared if their labels are equal and not null. Null or zero vectors, and those with a null or non-finite component, link with
    nothing, as do rows of null key, whose component is null. Vectors of unlike length under one label are not compared. Equal
    rows link with each other. Groups of near copies are hardly ever split, and leaves above the limit are compared in pairs of chunks, so none
    is cut short. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    v = F.col(vector).cast("array<double>")
    huge = F.lit(float("inf"))
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < huge)) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.when(fine & F.col(label).isNotNull() & F.col(key).isNotNull(), v).alias("vec"), F.col(label).alias("label"))
    good = rows.filter(F.col("vec").isNotNull())
    classes = keep(good.groupBy("label", "vec").agg(F.min("id").alias("cid"), F.count("*").alias("cnt")), "classes")
    root = F.shiftrightunsigned(F.xxhash64(F.col("label").cast("string"), F.size("vec")), 1)
    state = keep(classes.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), root.alias("node"), "cid", "cnt", "vec"), "forest")
    before = None
    for left in reversed(range(ROUNDS + 1)):  # the sizes are always those of the last state
        sizes = keep(state.groupBy("tree", "node").agg(F.count("*").alias("n")), "sizes")
        large = sizes.filter(F.col("n") > leaf).agg(F.sum("n")).first()[0] or 0
        if not left or not large or before is not None and large > 0.9 * before:
            break
        before, old, state = large, state, keep(_split(state, sizes, leaf, REACH * math.sqrt(max(0.0, 2 - 2 * least))), "forest")
        drop(old)
    mark = F.xxhash64("tree", "node").alias("node")
    state = state.select(mark, "cid", "cnt", "vec")
    nodes = keep(state.groupBy("cid").agg(F.array_distinct(F.collect_list("node")).alias("nodes")), "nodes")
    chunks = sizes.groupBy(mark).agg(F.max(F.ceil(F.col("n") / CHUNK)).cast("int").alias("q"))
    placed = state.join(nodes, "cid").join(keep(chunks, "chunks"), "node")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("q")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda k: F.struct(F.least("chunk", k).alias("i"), F.greatest("chunk", k).alias("j")))
    placed = placed.withColumn("_p", F.explode(pairs)).select("node", "cid", "cnt", "vec", "nodes", "chunk", "_p.i", "_p.j")
    found = placed.groupBy("node", "i", "j").applyInPandas(lambda x: _compared(x, least), "cid long, other long, links long")
    found = keep(found, "found")
    parts = keep(connected_components(found.select(F.col("cid").alias("u"), F.col("other").alias("v"))), "parts")
    links = found.groupBy(F.col("cid").alias("_l")).agg(F.sum("links").alias("links"))
    named = classes.join(links, F.col("cid") == F.col("_l"), "left").join(parts, F.col("cid") == F.col("node"), "left")
    named = keep(named.select(F.col("label").alias("_label"), F.col("vec").alias("_vec"), (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id")), "named")
    hit = rows.join(named, (F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec")), "left")
    return hit.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
