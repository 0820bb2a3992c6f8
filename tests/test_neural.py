"""Beam search, contexts, statuses and the first-generation model, against exhaustive search, loops and differences."""

import itertools
import math
import time

import numpy as np
import pytest

from varnika.operators import batches, evaluate, neural, plain_decoder, training
from varnika.plans import catalog

from test_training import SCHEMA, arrays, rows


def chances(ids, w, start, tokens):
    """Log probability of each of these tokens after the ones before, by the training's forward pass."""
    ids_out = np.array([[start, *tokens]])
    p = {k: v.astype(float) for k, v in w.items()}
    total = 0.0
    for t in range(len(tokens)):
        before = training.gradients(np.array([ids]), ids_out[:, : t + 1], p, back=False)[0] if t else 0.0
        total = -training.gradients(np.array([ids]), ids_out[:, : t + 2], p, back=False)[0]
        assert before >= 0
    return total


@pytest.mark.parametrize("additive", [False, True])
def test_beams_equal_exhaustive_search(additive):
    w = neural.random_weights(6, 5, 4, 4, 2, additive)
    w["out_b"] = w["out_b"] + np.float32([-1e4, 0, 0, 0, 0])  # id 0 is padding, which the loss leaves out: four tokens are left
    start, end, steps, ids = 1, 2, 4, np.array([[1, 2, 0], [5, 4, 3]])
    got = neural.beams(ids, w, start, end, 12, steps, width=300)
    for row, found in zip(ids, got, strict=True):
        want = []
        for n in range(1, steps + 1):
            for tokens in itertools.product(range(1, 5), repeat=n):
                if end not in tokens[:-1] and (tokens[-1] == end or n == steps):
                    want.append((chances(row, w, start, tokens) / n, list(tokens)))
        want = sorted(want, key=lambda x: -x[0])[:12]
        assert [t for _, t in found] == [t for _, t in want]
        assert np.allclose([s for s, _ in found], [s for s, _ in want], atol=1e-4)


def test_a_beam_of_one_is_greedy_and_batches_do_not_matter():
    for seed in range(6):
        w = neural.random_weights(6, 5, seed=seed)
        ids = np.random.default_rng(seed).integers(0, 6, (7, 4))
        assert [x[0][1] for x in neural.beams(ids, w, 1, 2, 1, 9)] == neural.run(ids, w, 1, 2, 9)
        together = neural.beams(ids, w, 1, 2, 3, 6)
        alone = [neural.beams(ids[k : k + 1], w, 1, 2, 3, 6)[0] for k in range(7)]
        assert [[t for _, t in x] for x in together] == [[t for _, t in x] for x in alone]


def test_contexts_are_computed_once_for_each_row_and_token(monkeypatch):
    w = neural.random_weights(6, 5, seed=1)
    ids = np.array([[1, 2, 0, 0], [3, 0, 0, 0]])
    near, *_ = neural.encoded(ids, w)
    fit = np.exp(neural.scores(neural.queries(w["dec_embed"][None], w), near.seen, w))
    want = (fit / fit.sum(axis=2, keepdims=True)) @ near.seen
    r, t = np.array([0, 1, 0, 0]), np.array([3, 4, 3, 2])
    assert np.allclose(near.of(r, t), want[r, t], atol=1e-5) and near.known.sum() == 3
    monkeypatch.setattr(neural, "scores", None)  # nothing is computed again
    assert np.allclose(near.of(r, t), want[r, t], atol=1e-5)
    monkeypatch.undo()
    whole = neural.beams(ids, w, 1, 2, 2, 8)
    monkeypatch.setattr(neural, "TABLE", 1)  # a row at a time
    parts = neural.beams(ids, w, 1, 2, 2, 8)
    assert [[t for _, t in x] for x in parts] == [[t for _, t in x] for x in whole]
    assert np.allclose([s for x in parts for s, _ in x], [s for x in whole for s, _ in x], atol=1e-5)


def test_statuses():
    w = neural.random_weights(4, 5)
    vi, vo = {"क": 1, "ख": 2, "ग": 3, "घ": 99}, {"a": 1, "^": 2, "$": 3, "k": 4}
    never, always = dict(w), dict(w)
    never["out_b"] = w["out_b"] + np.float32([0, 0, 0, -1e4, 0])
    always["out_b"] = w["out_b"] + np.float32([0, 0, 0, 1e4, 0])
    words = ["क", "खग", "Q", "घ", ""]
    got = neural.spell_checked(words, never, vi, vo, 5, 6)
    assert got["Q"] == ("", "oov") and got["घ"] == ("", "error")  # its id is beyond the weights, which costs the others nothing
    assert all(got[x] == (neural.spell([x], never, vi, vo, 5, 6)[x], "unfinished") for x in ("क", "खग", ""))
    assert {s for x, (_, s) in neural.spell_checked(words, always, vi, vo, 5, 6).items() if x not in "Qघ"} == {"ok"}
    assert neural.spell_checked(["क", "Q"], never, vi, vo, 5, 6, seconds=-1) == {"क": ("", "timeout"), "Q": ("", "oov")}
    began = time.monotonic()
    assert neural.spell_checked(["क"], never, vi, vo, 5, 10**9, seconds=0.2)["क"] == ("", "timeout") and time.monotonic() - began < 5


def test_checked_kernel_and_observed_failures(spark, tmp_path):
    neural.save_weights(str(tmp_path / "checked.npz"), neural.random_weights(4, 5))
    spark.sparkContext.addFile(str(tmp_path / "checked.npz"))
    vi, vo = {"क": 1, "ख": 2, "घ": 99}, {"a": 1, "^": 2, "$": 3, "k": 4}
    f = neural.checked_transliterator("checked.npz", vi, vo, 5, 6, None)
    df = spark.createDataFrame([("क ख",), ("क Q",), ("घ क",), (None,)], "t string").coalesce(1).select(f("t").alias("result"))
    watched, counts = evaluate.observed(df)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("observed", "")
    got = [tuple(r.result) for r in watched.collect()]
    n = evaluate.log_failures(counts)
    jobs = tracker.getJobIdsForGroup("observed")
    sc.setJobGroup("", "")
    want = neural.spell_checked(["क", "ख"], neural.random_weights(4, 5), vi, vo, 5, 6)
    assert got[0] == (f"{want['क'][0]} {want['ख'][0]}", min(want["क"][1], want["ख"][1], key=neural.STATUS.index))
    assert got[1:] == [(f"{want['क'][0]} ", "oov"), (f" {want['क'][0]}", "error"), ("", "null")]
    assert n == 2 and counts.get["n"] == 4 and len(jobs) == 1


def test_registered_k_best(spark):
    data = "/root/testdata/sf0.001"
    found: dict = {}
    for r in neural.k_best(catalog._part_words(spark, data), "word", catalog._shipped_weights(spark), catalog.VOCAB_IN, catalog.VOCAB_OUT, 5, 47, 20).collect():
        found.setdefault(r.word, []).append((r["rank"], r.guess, r.score))
    w = neural.random_weights(len(catalog.VOCAB_IN) + 1, len(catalog.VOCAB_OUT) + 1, seed=7)
    words = sorted(found)[:20]
    want = neural.spell_k_best(words, w, catalog.VOCAB_IN, catalog.VOCAB_OUT, 5, 47, 20)
    for x in words:
        got = sorted(found[x])
        assert [g for _, g, _ in got] == [g for g, _ in want[x]] and [k for k, _, _ in got] == list(range(1, len(got) + 1))
        assert np.allclose([s for _, _, s in got], [s for _, s in want[x]])
    assert len(found) == catalog._part_words(spark, data).count()


def test_plain_decoder_gradients_against_differences():
    w = {k: v.astype(float) for k, v in plain_decoder.random_weights(4, 6, 5, 3).items()}
    a, b = arrays(rows(5))
    _, n, grads = plain_decoder.gradients(a, b, w)
    assert n == b[:, 1:].size and set(grads) == set(w)
    rng = np.random.default_rng(0)
    for k, v in w.items():
        for at in rng.integers(0, v.size, 6):
            near = []
            for step in (1e-5, -1e-5):
                moved = v.copy()
                moved.flat[at] += step
                near.append(plain_decoder.gradients(a, b, w | {k: moved}, back=False)[0])
            assert grads[k].flat[at] == pytest.approx((near[0] - near[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_plain_decoder_learns_the_copy_task(spark):
    data = rows(60)
    df = spark.createDataFrame(data, SCHEMA).coalesce(1).cache()
    start = plain_decoder.random_weights(4, 6, 24, 1)
    best, history = training.train(df, start, df, epochs=14, patience=plain_decoder.PATIENCE, optimizer=training.RMSprop(0.02, decay=0.001), model=plain_decoder.gradients, metric=plain_decoder.misses)
    errors = [h["val_loss"] for h in history]
    assert min(errors) < 0.35 < 0.5 < errors[0] or min(errors) < 0.5 * errors[0]
    a, b = arrays(data)
    wrong, n, _ = plain_decoder.misses(a, b, best)
    assert wrong / n == pytest.approx(min(errors), abs=1e-3)
    made = plain_decoder.run(a, best, 1, 2, 4)
    right = sum(x[: x.index(2) + 1 if 2 in x else None] == y[1 : y.index(2) + 1] for x, y in zip(made, b.tolist(), strict=True))
    assert right > 60 * 0.1


def test_training_goes_on_from_a_checkpoint(spark, tmp_path):
    df = spark.createDataFrame(rows(30), SCHEMA).coalesce(1).cache()
    start = neural.random_weights(4, 6, 6, 8, 1)
    whole, course = training.train(df, start, df, epochs=5, steps=2, optimizer=training.Adam(0.02))
    folder = f"file://{tmp_path}/states"

    class Killed(Exception):
        pass

    class Fails(training.Adam):
        def apply(self, weights, grads):
            if self.steps == 7:  # in the midst of the fourth epoch
                raise Killed
            return super().apply(weights, grads)

    with pytest.raises(Killed):
        training.train(df, start, df, epochs=5, steps=2, optimizer=Fails(0.02), checkpoints=folder)
    assert training.Checkpoints(folder).versions() == [2, 3]
    (tmp_path / "states" / ".half-written").write_bytes(b"x")  # what a killed writer leaves is no version
    again, rest = training.train(df, start, df, epochs=5, steps=2, optimizer=training.Adam(0.02), checkpoints=folder)
    assert [h["epoch"] for h in rest] == [1, 2, 3, 4, 5] and [h["loss"] for h in rest] == [h["loss"] for h in course]
    assert all((again[k] == whole[k]).all() for k in whole)
    assert training.train(df, start, df, epochs=5, checkpoints=folder)[1] == rest  # nothing left to do


def test_buffered_batches(spark, tmp_path):
    df = spark.range(20_000).repartition(3)
    got = batches.with_batches(df, 8, 3000).collect()
    assert sorted(r.id for r in got) == list(range(20_000))
    sizes = [r.n for r in batches.batch_sizes(batches.with_batches(df, 8, 3000)).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 3
    order = [r.id for r in batches.shuffled_in_buffers(spark.range(20_000).coalesce(1), 3000).collect()]
    assert sorted(order) == list(range(20_000)) and order != sorted(order)
    moved = [abs(i - x) for i, x in enumerate(order)]
    assert np.mean(moved) > 1000
    path = str(tmp_path / "batches")
    batches.write_batches(df, path, 8, 3000)
    one = batches.read_batches(spark, path).filter("batch = 3")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and len(one.inputFiles()) == 8 and one.count() in (2499, 2500, 2501)
    assert batches.with_batches(df.limit(0), 4).count() == 0


def test_a_buffer_holds_no_more_than_its_size():
    import pyarrow as pa

    most, held = 0, 0

    def source():
        nonlocal held, most
        for k in range(200):
            held += 500
            most = max(most, held)
            yield pa.RecordBatch.from_arrays([pa.array(range(k * 500, k * 500 + 500))], ["x"])

    out = []
    for b in batches.through_buffer(source(), 4000, np.random.default_rng(1)):
        held -= b.num_rows
        out += b.column(0).to_pylist()
    assert sorted(out) == list(range(100_000)) and most <= 4000 + batches.CHUNK + 500
    early = [x for x in out[:1000]]
    assert min(early) >= 0 and max(early) < 7000 and not math.isclose(np.mean(np.diff(early)), 1.0)


@pytest.mark.parametrize("size", [0, 1, 1000, 2047, 2048, 2049])
def test_a_buffer_smaller_than_a_chunk_gives_each_row_once(size):
    import pyarrow as pa

    source = [pa.RecordBatch.from_arrays([pa.array(range(a, b))], ["x"]) for a, b in ((0, 3000), (3000, 3001), (3001, 9000))]
    got = [x for b in batches.through_buffer(iter(source), size, np.random.default_rng(1)) for x in b.column(0).to_pylist()]
    assert sorted(got) == list(range(9000)) and (size < 2 or got != sorted(got))
