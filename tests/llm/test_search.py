"""Spelling variants, exact top-k search and hard negatives against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from varnika.llm import negatives, spelling, topk, vectors

DOCS = "doc_id long, text string, word string, n long, key int"


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, letters=5, least=3, times=2):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= letters and n >= least}
    out, form = {}, {}
    for w, n in words.items():
        near = sorted(((-m, o) for o, m in words.items() if distance_one(w, o)), key=lambda x: (x[0], x[1].encode()))
        if near and -near[0][0] >= times * n:
            form[w] = near[0][1]
        out[w] = [form.get(w), n, len(near), words[form[w]] if w in form else None]
    rows = []
    for w, (f, n, k, m) in out.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, f, root, n, k, m))
    return sorted(rows)


def made_docs():
    r = random.Random(5)
    base = ["colour", "bookkeeper", "aaaaaa", "naïve", "Éclair", "strasse", "x" * 70, "ab" * 40]
    docs = []
    for i in range(120):
        words = []
        for _ in range(30):
            w = r.choice(base)
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abkÀéx") + w[at:], w[:at] + r.choice("abkÀéx") + w[at + 1 :]])
            words.append(r.choice([w, w, w.upper() if w.isascii() else w]))
        docs.append((i, r.choice([" ", "-", "1\n"]).join(words)))
    docs += [(None, "colour colour bookkeeper"), (7, None), (8, ""), (9, "×÷ ×÷×÷÷÷ ×÷×÷÷÷ ×÷×÷÷÷ ×÷×÷÷"), (9, "Ünder ünder"), (9, "Ünder ünder"), (None, None)]
    return docs + docs[:5]


def test_variants(spark):
    docs = made_docs()
    df = spark.createDataFrame([(*d, "w", 1, 2) for d in docs], DOCS).repartition(3)
    got = sorted(tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = plain_variants(docs)
    assert got == want
    assert any(len(w) > 64 and k for w, _, _, _, k, _ in want) and any(r != w and r != f for w, f, r, *_ in want)
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0


def test_very_long_words(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=100_000))
    docs = [(i, f"{long} {long[:500]}q{long[501:]} short") for i in range(8)]
    df = spark.createDataFrame([(*d, "w", 1, 2) for d in docs], DOCS)
    got = {r.word: r.n_near for r in spelling.variants(df).collect()}
    assert got[long] >= 1 and got["short"] == 0


def test_deletion_keys_are_those_of_the_shorter_words():
    words = ["abbba", "x", "aaaa", "éÀé"]
    row, key, lo, hi, size = spelling.deletions(words)
    for w in range(len(words)):
        mine = [(key[i], lo[i], hi[i]) for i in np.flatnonzero(row == w) if lo[i] >= 0]
        shorter = {words[w][:i] + words[w][i + 1 :] for i in range(len(words[w]))}
        assert len(mine) == len(shorter) and all(size[row == w] == len(words[w]))
        for k, a, b in mine:
            assert {words[w][:i] + words[w][i + 1 :] for i in range(a, b + 1)} <= shorter
            assert k == spelling.deletions([words[w][:a] + words[w][a + 1 :]])[1][0]


VECTORS = "vec_id long, embedding array<float>, label string, id int, dim int, part int"


def made_vectors(n=900, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v], str(i % 4)) for i, v in enumerate(rng.normal(0, 0.3, (n, dim)).astype(np.float32))]
    same = rows[10][1]
    rows = [(i, same if i % 3 == 0 else v, lab) for i, v, lab in rows]  # a third are copies
    near = np.float32(same) + rng.normal(0, 0.02, (60, dim)).astype(np.float32)
    rows += [(n + i, [float(x) for x in v], "1") for i, v in enumerate(near)]
    odd = [None, [], [float("nan")] * dim, [None] * dim, [float("inf")] * dim, [1.0, 2.0], [0.0] * dim, [-0.5] * dim]
    rows += [(5000 + 50 * i, v, "2") for i, v in enumerate(odd)] + [(6000, [0.5, 0.25], None), (None, [1.0] * dim, "1"), (6001, [0.5, 1.0], "9"), (7000, [3.0], "1")]
    return rows


def plain_scores(rows, labels):
    good = {}
    for i, v, lab in rows:
        if i is None or v is None or labels and lab is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = (lab if labels else "", [int(np.floor(256 * float(np.float32(c)))) for c in v])
        good[i] = min(good.get(i, x), x)
    return {a: sorted((-sum(x * y for x, y in zip(va, vb, strict=True)), b) for b, (_, vb) in good.items() if b != a and len(va) == len(vb)) for a, (_, va) in good.items()}, {i: x[0] for i, x in good.items()}


@pytest.fixture
def small_tiles(monkeypatch):
    for name, value in (("BLOCK", 256), ("GROUP", 8), ("AT_ONCE", 700), ("FAN", 2)):
        monkeypatch.setattr(vectors, name, value)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in [*rows, rows[0], rows[50]]], VECTORS).repartition(3)


@pytest.mark.parametrize("k", [1, 5, 2000])
def test_top_k(spark, small_tiles, k):
    rows = made_vectors()
    got = sorted(tuple(r) for r in topk.top_k(frame(spark, rows), F.col("id") % 50 == 0, k).collect())
    ranks, _ = plain_scores(rows, False)
    assert got == sorted((q, r, b, -s) for q, found in ranks.items() if q % 50 == 0 for r, (s, b) in enumerate(found[:k], 1))
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("id") % 50 == 0).count() == 0


def test_hard_negatives(spark, small_tiles):
    rows = made_vectors()
    got = sorted(tuple(r) for r in negatives.hard_negatives(frame(spark, rows), F.col("id") % 10 == 0).collect())
    ranks, label = plain_scores(rows, True)
    want = []
    for a, found in ranks.items():
        if a % 10 == 0:
            for s, p in [x for x in found if label[x[1]] == label[a]][:5]:
                inside = [x for x in found if label[x[1]] != label[a] and 80 * -s <= 100 * -x[0] <= 100 * -s]
                want += [(a, p, r, b, -s, -t) for r, (t, b) in enumerate(inside[:5], 1)]
    assert got == sorted(want) and want
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("id") % 10 == 0).count() == 0


def test_bounds_hold_every_score_and_rule_most_rows_out():
    rng = np.random.default_rng(2)
    data = np.floor(256 * rng.normal(0, 0.125, (4000, 64))).astype(np.int64)
    data[:500] = data[0]
    near = negatives.Approximation(data)
    lower, upper = near.bounds(data[:20].astype(float))
    scores = data[:20] @ data.T
    assert (lower <= scores).all() and (scores <= upper).all()
    a = 600
    lower, upper = near.bounds(data[a : a + 1].astype(float))
    assert (upper[0] >= negatives.reach(lower[0], np.arange(4000) != a, 5)).sum() < 100


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(0, [4.0e6, 1.0], "a"), (1, [4.0e6, 0.5], "a"), (2, [3.9e6, -1.0], "b"), (3, [1e200, 1.0], "b"), (4, [-1e200, 0.0], "a")]
    got = topk.top_k(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS.replace("float", "double")), F.col("id") == 0, 9).collect()
    big = int(np.iinfo(np.int64).max)
    cells = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows[:3]}
    want = [(3, big), *sorted(((i, sum(x * y for x, y in zip(cells[0], cells[i], strict=True))) for i in (1, 2)), key=lambda x: -x[1]), (4, -big)]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == want
    many = negatives.hard_negatives(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS.replace("float", "double")), F.col("id") == 0).collect()
    assert {(r.positive_id, r.negative_id) for r in many} == {(1, 2)}


def test_first_takes_no_more_than_k_of_equal_scores():
    scores = np.array([[3, 3, 3, 1, 3], [1, 2, 3, 4, 5]])
    at, column = vectors.first(scores, 2, np.array([[False, True, True, True, True]] * 2))
    assert list(zip(at.tolist(), column.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 3), (1, 4)]
