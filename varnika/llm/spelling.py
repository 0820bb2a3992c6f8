"""Spelling variants by a symmetric-delete join.

Every word emits a key for itself and one for each of its distinct single deletions; words that share a key are joined and verified to
differ by exactly one code point. A run of equal letters gives one deletion, which holds for every place of the run. Two words of a
length share the deletion that counts where their runs meet (the place at which they differ), and words whose lengths differ by
one where the key is the shorter word itself: so each pair is found once, and nothing has to be made distinct. A key is held by at most
one word for each letter and place, so its pairs are bounded by the alphabet and the length of words, not by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, drop, keep, tidy

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every so many-th run, by hash, has a letter deleted.
DAMAGE = 97
#: Keys of words up to this length carry the word; longer ones have a key per letter, so they carry a number instead.
SHORT = 64
#: Two primes below 2**31, and a base of the polynomial hash for each; both together make a key of 62 bits.
PRIMES, BASES = (2147483647, 2147483629), (48271, 69621)
KEYS = "key long, lo int, hi int, len int, name {kind}, n long"


def runs(text: Column) -> Column:
    """The maximal runs of letters of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0))


def lowered(word: Column) -> Column:
    """word with A-Z in lower case and all else as it is."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def damaged(word: Column, key: Column) -> Column:
    """word without one letter if the hash of key and word says so; a null key counts as empty."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", letters: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the words of at least so many code points that occur at least so often in all texts. Counts are added up before the shuffle."""
    each = docs.select(F.col(key).alias("_key"), F.explode(runs(F.col(text))).alias("_run")).select("_key", lowered(F.col("_run")).alias("_run"))
    words = each.select(damaged(F.col("_run"), F.col("_key")).alias("word")).filter(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:  # twice as many each time
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def deletions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, lo, hi, len) of each key: first those of the words themselves (lo = hi = -1), then their distinct single deletions.

    lo and hi are the first and the last place whose deletion gives the key. Keys come from sums over the letters before and
    after the place, so the time is linear in the length.
    """
    length = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(words)), length)
    first = np.cumsum(length) - length
    place = np.arange(len(letters)) - first[row]
    fresh = (place == 0) | (letters != np.concatenate([[0], letters[:-1]]))
    at = np.flatnonzero(fresh)
    end = np.append(at[1:], len(letters))[: len(at)] - 1
    whole, cut = np.zeros(len(words), np.uint64), np.zeros(len(at), np.uint64)
    for k, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
        p, inverse = np.uint64(prime), np.uint64(pow(base, -1, prime))
        sums = np.concatenate([[0], np.cumsum((letters + np.uint64(1)) * _powers(base, prime, int(length.max(initial=0)))[place] % p)]).astype(np.uint64)
        of = lambda a, b, s=sums, p=p: (s[b] - s[a]) % p
        start, stop = first[row[at]], (first + length)[row[at]]
        own, less = of(first, first + length), (of(start, at) + of(at + 1, stop) * inverse) % p
        shift = np.uint64(31 * k)
        whole, cut = whole | own << shift, cut | less << shift
    none = np.full(len(words), -1)
    return np.concatenate([np.arange(len(words)), row[at]]), np.concatenate([whole, cut]).astype(np.int64), np.concatenate([none, place[at]]), np.concatenate([none, place[end]]), np.concatenate([length, length[row[at]]])


def keyed(words: DataFrame, name: str) -> DataFrame:
    """The keys of words (word, n), each with `name`, a column that stands for the word."""
    kind = dict(words.dtypes)[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, key, lo, hi, size = deletions(b.column("word").to_pylist())
            taken = [pc.take(b.column(c), pa.array(row)) for c in (name, "n")]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(size, pa.int32()), *taken], ["key", "lo", "hi", "len", "name", "n"])

    return words.select("word", "n", *([name] if name != "word" else [])).mapInArrow(run, KEYS.format(kind=kind))


def _met(keys: DataFrame) -> DataFrame:
    """(a, an, b, bn, at) of the names that meet at a key in a way that one edit explains, at place `at`; each pair once."""
    l, r = keys.alias("l"), keys.alias("r")
    own, other = F.col("l.lo") < 0, F.col("r.lo") < 0
    swapped = ~own & ~other & (F.col("l.len") == F.col("r.len")) & (F.col("l.lo") <= F.col("r.hi")) & (F.col("r.lo") <= F.col("l.hi"))
    met = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.name") < F.col("r.name")) & ((own != other) | swapped))
    return met.select(F.col("l.name").alias("a"), F.col("l.n").alias("an"), F.col("r.name").alias("b"), F.col("r.n").alias("bn"), F.greatest("l.lo", "r.lo").alias("at"))


def _one_apart(a: Column, b: Column, at: Column) -> Column:
    """Whether two different words are equal without the letter at this place: of the longer, or of both if they have one length."""
    without = lambda w: F.concat(F.substring(w, F.lit(1), at), F.substring(w, at + 2, F.length(w)))
    return F.when(F.length(a) == F.length(b), without(a) == without(b)).when(F.length(a) > F.length(b), without(a) == b).otherwise(without(b) == a)


def near(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): the pairs of words (word, n) that differ by exactly one inserted, deleted or replaced code point, each once."""
    spark, size = words.sparkSession, F.length("word")
    with arrow_batches(spark, 20_000):
        keys = keep(keyed(words.filter(size <= SHORT), "word"), "keys")
    found = _met(keys)
    long = keep(words.filter(size >= SHORT).withColumn("id", F.monotonically_increasing_id()), "long")
    if not long.isEmpty():
        with arrow_batches(spark, 100, "64k"):
            keys = keep(keyed(long, "id"), "keys")
        named = lambda p: long.select(F.col("id").alias(f"_{p}"), F.col("word").alias(f"{p}_word"))
        met = _met(keys).join(named("a"), F.col("a") == F.col("_a")).join(named("b"), F.col("b") == F.col("_b"))
        met = met.select(F.col("a_word").alias("a"), "an", F.col("b_word").alias("b"), "bn", "at")
        found = found.unionByName(met.filter((F.length("a") > SHORT) | (F.length("b") > SHORT)))
    return found.filter(_one_apart(F.col("a"), F.col("b"), F.col("at"))).drop("at")


def roots(forms: DataFrame) -> DataFrame:
    """From (word, form), where forms make no circle: (word, root), the last form reached. Steps double, so rounds are the logarithm of the longest way."""
    state = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = state.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        new = keep(state.join(after, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        drop(state)
        moved, state = not new.filter("moved").isEmpty(), new
        if not moved:
            return state.drop("moved")


@tidy
def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", letters: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of vocabulary().

    A word's form is its near word of largest n (ties: the smallest), if that is at least `times` the word's n (above 1, so that forms make no circle), else null;
    root follows forms to the last. Null and empty texts have no words; a null key counts as empty; repeated rows count each; very long texts and words are
    read whole; other columns are not read; an empty table gives an empty result.
    """
    words = keep(vocabulary(docs, text, key, letters, least), "words")
    pairs = near(words)
    ends = F.explode(F.array(F.struct(F.col("a").alias("of"), F.col("b").alias("by"), F.col("bn").alias("m")), F.struct(F.col("b").alias("of"), F.col("a").alias("by"), F.col("an").alias("m")))).alias("x")
    best = pairs.select(ends).groupBy(F.col("x.of").alias("_of")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("x.m")).alias("m"), F.col("x.by").alias("by"))).alias("best"))
    df = words.join(best, F.col("word") == F.col("_of"), "left")
    chosen = -F.col("best.m") >= times * F.col("n")
    df = keep(df.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.by")).alias("form"), F.when(chosen, -F.col("best.m")).alias("form_n")), "forms")
    last = roots(df.filter("form is not null")).select(F.col("word").alias("_w"), "root")
    return df.join(last, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
