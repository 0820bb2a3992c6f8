"""Near-duplicate documents by MinHash: universal hash minima, banding, verification and connected components.

Documents with equal shingle sets form a class first, so copies never meet each other. Each class has `bands` keys of `rows`
minima. Round one checks each class against the smallest class with which it shares a key, and joins what is confirmed
into components. Round two goes, within each key that still holds several components, through the pairs across components, in
blocks of a bounded number of classes and shingles and without listing them, so every candidate pair is either confirmed, refuted or already joined. A pair that
shares several keys counts in the first. A check first compares 8-bit signatures, then the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, keep, tidy
from .components import connected_components

MASK = (1 << 64) - 1
#: Classes of one key are compared in blocks of up to twice so many, and of up to twice about so many shingles, but for a single class of more.
CHUNK, SHINGLES = 512, 200_000
#: Bytes of text that are cut into words at once.
PIECE = 1 << 18
ROWS = "band long, pos int, i int, j int, chunk int, node long, c long, n long, sig binary, bands array<long>"
#: A list of ids of up to this many rows (8 bytes each) may be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 500_000
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of some bytes."""
    space = _space[data]
    before = np.empty_like(space)
    before[:1], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    after = np.empty_like(space)
    after[-1:], after[:-1] = True, space[1:]
    length = np.flatnonzero(~space & after) + 1 - starts
    letters = np.flatnonzero(~space)
    first = np.cumsum(length) - length
    offset = np.arange(len(letters)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15 | 1, np.uint64))
    value = (data[letters].astype(np.uint64) + np.uint64(1)) * power[offset]
    return _mixed(np.add.reduceat(value, first) + length.astype(np.uint64)), starts


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, bytes) of consecutive parts of about PIECE bytes, cut at white space; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data):
            gap = np.flatnonzero(_space[data[end : end + PIECE]])
            if len(gap):
                end += int(gap[0])
                break
            end += PIECE
        yield at, data[at:end]
        at = end


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct word shingles.

    A-Z are lower-cased; ASCII white space separates words. Fewer words than `size` are one shingle; none, or null, give an empty set.
    Texts are cut into words a few hundred kilobytes at a time, however long they are.
    """
    k = _odd(size + 1, 41)
    low = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    i = 0
    while i < len(low):
        j, total = i, 0
        while j < len(low) and (j == i or total + len(low[j]) < PIECE):
            total += len(low[j]) + 1
            j += 1
        found = [(h, s + at) for at, part in _pieces(np.frombuffer(b"\n".join([*low[i:j], b""]), np.uint8)) for h, s in [_words(part)]]
        word, starts = (np.concatenate(x) for x in zip(*found, strict=True))
        ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in low[i:j]]))
        n = max(0, len(word) - size + 1)
        gram = np.zeros(n, np.uint64)
        for step in range(size):
            gram += word[step : step + n] * k[step]
        gram = _mixed(gram)
        at = 0
        for end in ends:
            if end - at >= size:
                yield np.unique(gram[at : end - size + 1])
            elif end > at:
                yield _mixed((word[at:end] * k[: end - at]).sum(keepdims=True, dtype=np.uint64) + k[size:] * np.uint64(end - at))
            else:
                yield np.zeros(0, np.uint64)
            at = end
        i = j


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash (multiply, add, take the high half) over a set."""
    best = np.full(len(a), 1 << 32, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(best, ((shingles[i : i + 1024, None] * a + b) >> np.uint64(32)).min(axis=0), out=best)
    return best


def _packed(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    short, long = (p, q) if len(p) <= len(q) else (q, p)
    if not len(long) or 100 * len(short) < percent * len(long):
        return False
    inter = int(np.count_nonzero(long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short))
    return 100 * inter >= percent * (len(p) + len(q) - inter)


def signatures(docs: DataFrame, text: str, key: str, size: int, bands: int, rows: int) -> DataFrame:
    """(id, n, digest, sig, bands) for each row; digest, sig and bands are null for an empty set."""
    a, b = _odd(bands * rows, 7), _odd(bands * rows, 11)
    c, salt = _odd(rows, 13), _odd(bands, 17)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s in shingle_sets([t if isinstance(t, str) else None for t in batch["_text"]], size):
                if len(s):
                    m = minima(s, a, b)
                    keys = _mixed((m.reshape(bands, rows) * c).sum(axis=1, dtype=np.uint64) + salt).view(np.int64)
                    out.append((len(s), hashlib.md5(_packed(s)).digest(), (m & np.uint64(255)).astype(np.uint8).tobytes(), keys))
                else:
                    out.append((0, None, None, None))
            made = pd.DataFrame(out, columns=["n", "digest", "sig", "bands"])
            made.insert(0, "id", batch["id"].to_numpy())
            yield made

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text")).mapInPandas(run, "id long, n long, digest binary, sig binary, bands array<long>")


def _listed(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _alike(pairs: DataFrame, sig: DataFrame, bits: float) -> DataFrame:
    """The pairs whose signatures agree in a share of at least `bits`."""
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("_x")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("_y")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                p, q = (np.frombuffer(b"".join(x[c]), np.uint8).reshape(len(x), -1) for c in ("_x", "_y"))
                yield x.loc[(p == q).mean(axis=1) >= bits, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, by their full sets."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("_x")), "a")
    hubs = sets.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
    both = left.join(hubs.select(F.col("node").alias("b"), F.col("set").alias("_y")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yes = [_similar(_unpacked(p), _unpacked(q), percent) for p, q in zip(x["_x"], x["_y"], strict=True)]
            yield x.loc[np.array(yes, bool), ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks (equal band, i and j) of rows that come sorted by these."""
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        k = b[["band", "i", "j"]].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y - x > 1:
                yield b.iloc[x:y]
        held = b.iloc[cuts[-1] :]
    if held is not None and len(held) > 1:
        yield held


def _open_pairs(x: pd.DataFrame, percent: int, bits: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (a, b) and agreement of the block's pairs across components that this key and block are to settle and that may link."""
    c, n, chunk = x["c"].to_numpy(), x["n"].to_numpy(), x["chunk"].to_numpy()
    sig = np.frombuffer(b"".join(x["sig"]), np.uint8).reshape(len(x), -1)
    keys = np.stack(list(x["bands"]))
    i, j, pos = (int(x[k].iloc[0]) for k in ("i", "j", "pos"))
    out = []
    for at in range(0, len(x) - 1, 64):
        rows = np.arange(at, min(at + 64, len(x) - 1))
        fit = (c[rows, None] != c[None, :]) & (100 * np.minimum(n[rows, None], n[None, :]) >= percent * np.maximum(n[rows, None], n[None, :]))
        fit &= np.arange(len(x))[None, :] > rows[:, None]
        if i != j:
            fit &= chunk[rows, None] != chunk[None, :]
        a, b = np.nonzero(fit)
        a = rows[a]
        share = (sig[a] == sig[b]).mean(axis=1)
        some = share >= bits
        a, b, share = a[some], b[some], share[some]
        some = (keys[a] == keys[b]).argmax(axis=1) == pos
        out.append((a[some], b[some], share[some]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _blocks(placed: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows (band, pos, node, c, chunk, _b) of keys that hold several components, once for each block (_b.i, _b.j) they are in.

    Within a key, chunks of the component of most rows come first and meet only the chunks of the other components, never each
    other: what is joined already is not compared. So a few strangers among many copies cost work in proportion to the copies.
    """
    sized = placed.join(reps.select(F.col("node").alias("_r"), "n"), F.col("node") == F.col("_r")).drop("_r")
    parts = keep(sized.groupBy("band", "c").agg(F.count("*").alias("_k"), F.sum("n").alias("_n")), "sides")
    held = parts.groupBy("band").agg(F.count("*").alias("_parts"), F.max(F.struct("_k", "_n", F.col("c").alias("_c"))).alias("_top"), F.sum("_k").alias("_k"), F.sum("_n").alias("_n")).filter("_parts > 1")
    need = lambda k, n: F.greatest(F.ceil(k / F.lit(CHUNK)), F.ceil(n / F.lit(SHINGLES))).cast("int")
    held = held.select(F.col("band").alias("_key"), F.col("_top._c").alias("_most"), need(F.col("_top._k"), F.col("_top._n")).alias("q"), need(F.col("_k") - F.col("_top._k"), F.col("_n") - F.col("_top._n")).alias("r"))
    held = keep(held, "mixed")
    df = placed.join(held, F.col("band") == F.col("_key")).withColumn("_large", F.col("c") == F.col("_most"))
    df = df.withColumn("chunk", F.when(F.col("_large"), F.pmod(F.xxhash64("node"), F.col("q"))).otherwise(F.col("q") + F.pmod(F.xxhash64("node"), F.col("r"))).cast("int"))
    others = F.when(F.col("_large"), F.sequence(F.col("q"), F.col("q") + F.col("r") - 1)).otherwise(F.sequence(F.lit(0), F.col("q") + F.col("r") - 1))
    blocks = F.transform(others, lambda k: F.struct(F.least("chunk", k).alias("i"), F.greatest("chunk", k).alias("j")))
    return df.select("band", "pos", "node", "c", "chunk", F.explode(blocks).alias("_b"))


def _candidates(rows: DataFrame, percent: int, bits: float) -> DataFrame:
    """The rows of blocks that have a pair to settle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _runs(batches):
            a, b, _ = _open_pairs(x, percent, bits)
            if len(a):
                yield x.iloc[np.unique(np.concatenate([a, b]))]

    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInPandas(run, ROWS)


def _settled(rows: DataFrame, percent: int, bits: float) -> DataFrame:
    """Links (a, b) across components, by the full sets: enough of them to join all that is linked within a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _runs(batches):
            a, b, share = _open_pairs(x, percent, bits)
            sets, node = [_unpacked(v) for v in x["set"]], x["node"].to_numpy()
            _, root = np.unique(x["c"].to_numpy(), return_inverse=True)
            links = []
            for k in np.argsort(-share, kind="stable"):
                p, q = a[k], b[k]
                if root[p] != root[q] and _similar(sets[p], sets[q], percent):
                    links.append((node[p], node[q]))
                    root[root == root[q]] = root[p]
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInPandas(run, "a long, b long")


@tidy
def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) for every row.

    Null or blank texts have no shingle and link with nothing; null keys link with nothing and have no component.
    Rows of one key are one document: they link with what any of their texts links with. At a similarity of 0.8 a pair is
    missed with probability 3e-6 (bands 32, rows 5). Very long texts are shingled whole, a piece at a time; other columns, whatever their names, are
    not read. A key of many components repeats its rows once for each chunk of them, so its work grows with their square. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with arrow_batches(spark, 512):
        base = keep(signatures(docs, text, key, size, bands, rows), "signatures")
    some = base.filter("n > 0 and id is not null")
    classes = keep(some.groupBy("digest").agg(F.min("id").alias("node")), "classes")
    reps = some.join(classes.withColumnRenamed("digest", "_d"), (F.col("digest") == F.col("_d")) & (F.col("id") == F.col("node"))).select("node", "n", "sig", "bands")
    reps = keep(reps.dropDuplicates(["node", "n", "sig"]), "reps")
    keyed = reps.select("node", F.posexplode("bands").alias("pos", "band"))
    shared = keep(keyed.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("_times")).filter("_times > 1").select("band", "hub"), "shared")
    met = keep(keyed.join(shared, "band"), "met")  # the rows of keys with several classes
    nodes = keep(met.select("node").distinct(), "nodes")
    few = nodes.count()
    sig = keep(reps.select("node", "sig").join(nodes, "node", "left_semi"), "sig")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"node": x["node"], "set": [_packed(s) for s in shingle_sets([t if isinstance(t, str) else None for t in x["_text"]], size)]})

    wanted = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("_text")).join(_listed(nodes, few), "node", "left_semi")
    with arrow_batches(spark, 512):
        full = keep(wanted.mapInPandas(sets, "node long, set binary").filter("octet_length(set) > 0"), "sets")
    # 8-bit values of unequal minima agree once in 256; five deviations of bands * rows draws below the limit
    s = percent / 100
    bits = s + (1 - s) / 256 - 5 * (s * (1 - s) / (bands * rows)) ** 0.5
    with arrow_batches(spark, 2048):
        first = keep(_alike(met.filter("node <> hub").groupBy("node").agg(F.min("hub").alias("b")).select(F.col("node").alias("a"), "b"), sig, bits), "alike")
        links = keep(_confirmed(first, full, percent), "links")
    parts = keep(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")
    placed = met.join(parts.withColumnRenamed("node", "_p"), F.col("node") == F.col("_p"), "left").select("band", "pos", "node", F.coalesce("component", "node").alias("c"))
    placed = keep(placed, "placed")
    open_ = keep(_blocks(placed, reps), "open")
    full_rows = reps.select(F.col("node").alias("_r"), "n", "sig", "bands")
    open_ = open_.join(full_rows, F.col("node") == F.col("_r")).select("band", "pos", "_b.i", "_b.j", "chunk", "node", "c", "n", "sig", "bands")
    with arrow_batches(spark, 2048):
        rest = keep(_candidates(open_, percent, bits), "rest")
    with arrow_batches(spark, 512):
        more = keep(_settled(rest.join(full.withColumnRenamed("node", "_f"), F.col("node") == F.col("_f")).drop("_f"), percent, bits), "links2")
    if not more.isEmpty():
        joined = parts.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more.select("a", "b"))
        parts = keep(connected_components(joined), "parts2")
    named = classes.join(parts.withColumnRenamed("node", "_p"), F.col("node") == F.col("_p"), "left")
    named = keep(named.select(F.col("digest").alias("_d"), F.coalesce("component", "node").alias("component_id")), "named")
    alone = F.coalesce("digest", F.unhex(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))))
    rows_ = base.select("id", "n", alone.alias("digest")).join(named, F.col("digest") == F.col("_d"), "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return rows_.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), found.alias("component_id"))


@tidy
def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The rows of docs but for those whose component has a smaller key; of repeated rows, one stays."""
    found = keep(groups(docs, text, key, **how), "groups")
    gone = keep(found.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone")).distinct(), "gone")
    again = keep(found.groupBy(F.col(key).alias("_again")).count().filter("count > 1 and _again is not null").select("_again"), "again")
    left = docs.join(_listed(gone, gone.count()), docs[key] == gone["_gone"], "left_anti")
    times = again.count()
    if not times:
        return left
    twice = left.join(_listed(again, times), left[key] == again["_again"], "left_semi").dropDuplicates()
    return left.join(_listed(again, times), left[key] == again["_again"], "left_anti").unionByName(twice)
