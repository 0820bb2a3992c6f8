"""Packing documents into fixed windows of tokens by minimum bin slack.

A document gives full windows and one remainder. Remainders of equal length are interchangeable, so the driver packs a table
of at most window - 1 counts: the longest remainder left opens a window, a subset-sum over bit sets finds the multiset of the
others that comes closest to filling it (within the counts), and the pattern is applied as often as the counts allow. Each
pattern at least halves a count, so there are at most about window * log2(documents) patterns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, keep, prefix_sum, tidy
from .tokens import Tokens

PIECE = "_key {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset (length to number) that fills a window best; it holds the greatest length in counts.

    Full windows come first, then sums that are a power of two (they need no padding), then the greatest sum.
    """
    lengths = sorted(counts, reverse=True)
    first = lengths[0]
    goal = window - first
    mask, reach, steps = (1 << (goal + 1)) - 1, 1, []
    for n in lengths:
        left = min(counts[n] - (n == first), goal // n)
        k = 1
        while left > 0 and not reach >> goal & 1:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= reach << (n * k) & mask
            left -= k
            k *= 2
        if reach >> goal & 1:
            break
    at = goal
    if not reach >> goal & 1:
        powers = [1 << p for p in range(window.bit_length()) if first <= 1 << p <= window and reach >> ((1 << p) - first) & 1]
        at = powers[-1] - first if powers else reach.bit_length() - 1
    chosen = {first: 1}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            at -= n * k
            chosen[n] = chosen.get(n, 0) + k
    return chosen


def patterns(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """All remainders packed: (times, multiset) in order."""
    counts, out = {n: c for n, c in counts.items() if c > 0}, []
    while counts:
        chosen = fill(counts, window)
        times = min(counts[n] // k for n, k in chosen.items())
        out.append((times, chosen))
        for n, k in chosen.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
    return out


def layout(packed: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, number in a window, first window, offset in it), by rank."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    window = 0
    for times, chosen in packed:
        offset = 0
        for n in sorted(chosen, reverse=True):
            rows.setdefault(n, []).append((used.get(n, 0), chosen[n], window, offset))
            used[n] = used.get(n, 0) + times * chosen[n]
            offset += n * chosen[n]
        window += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def tokenized(docs: DataFrame, text: str, key: str, path: str, end: int, window: int) -> DataFrame:
    """(_key, tokens, crcs): token count with the end id, and the CRC-32 of each window-long piece of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(path)
        for b in batches:
            total, crcs = [], []
            for ids in tokens.encode(b.column("_text")):
                data = np.append(ids, np.uint32(end)).astype("<u4").tobytes()
                total.append(len(data) // 4)
                crcs.append([zlib.crc32(data[i : i + 4 * window]) for i in range(0, len(data), 4 * window)])
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(total, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["_key", "tokens", "crcs"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, tokens long, crcs array<long>")


@tidy
def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", window: int = 2048, end: int = 1) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Null and empty texts are one piece of the end id alone. Repeated rows and null keys are documents of their own. A document longer than
    the window is cut at its multiples, however long. Only counts by remaining length reach the driver. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    with arrow_batches(spark, 4096, "8m"):
        rows = keep(tokenized(docs, text, key, tokenizer, end, window), "tokens")
    rows = rows.withColumns({"_rest": (F.col("tokens") % window).cast("int"), "_full": F.expr(f"tokens div {window}"), "_one": F.lit(0)})
    counts = {r[0]: r[1] for r in rows.groupBy("_rest").count().collect()}
    n = sum(counts.values())
    total = rows.agg(F.sum("_full")).first()[0] or 0
    counts.pop(0, None)
    where = layout(patterns(counts, window))
    rows = rows.withColumn("_order", F.xxhash64("crcs"))
    rows = keep(prefix_sum(rows, ["_rest"], ["_key", "_order"], None, "_rank", n, 5_000), "ranked")
    rows = prefix_sum(rows, ["_one"], ["_key", "_order"], "_full", "_ahead", n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pieces = b["crcs"].map(len).to_numpy()
            at = np.repeat(np.arange(len(b)), pieces)
            k = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            tokens, rest, rank, before = (b[c].to_numpy() for c in ("tokens", "_rest", "_rank", "_ahead"))
            seq, off = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for r in np.unique(rest[rest > 0]):
                mine, x = rest == r, where[int(r)]
                i = np.searchsorted(x[:, 0], rank[mine], "right") - 1
                within = rank[mine] - x[i, 0]
                seq[mine] = total + x[i, 2] + within // x[i, 1]
                off[mine] = x[i, 3] + within % x[i, 1] * r
            whole = k < tokens[at] // window
            yield pd.DataFrame({
                "_key": b["_key"].to_numpy()[at], "start": k * window, "length": np.where(whole, window, rest[at]), "ids_crc32": np.concatenate([*b["crcs"], np.zeros(0, np.int64)]).astype(np.int64),
                "doc_tokens": tokens[at], "sequence_id": np.where(whole, before[at] + k, seq[at]), "offset": np.where(whole, 0, off[at]),
            })

    out = rows.select("_key", "tokens", "crcs", "_rest", "_rank", "_ahead").mapInPandas(run, PIECE.format(key=kind))
    return out.withColumnRenamed("_key", key)
