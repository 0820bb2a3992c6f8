"""Training: gradients against differences, sums over partitions, early stopping, learning a small task."""

import numpy as np
import pytest

from varnika.operators import neural, training

SCHEMA = "ids_in array<int>, ids_out array<int>"


def rows(n, seed=1):
    """Words of three letters to copy, with a start (1), an end (2) and padding (0)."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        w = rng.integers(1, 4, rng.integers(1, 4)).tolist()
        out.append((w + [0] * (3 - len(w)), [1, *[x + 2 for x in w], 2, *[0] * (3 - len(w))]))
    return out


def arrays(data):
    return np.array([a for a, _ in data]), np.array([b for _, b in data])


@pytest.mark.parametrize("additive", [False, True])
def test_gradients_against_differences(additive):
    w = {k: v.astype(float) for k, v in neural.random_weights(4, 6, 4, 4, 3, additive).items()}
    a, b = arrays(rows(5))
    _, n, grads = training.gradients(a, b, w)
    assert n == b[:, 1:].size and set(grads) == set(w)
    rng = np.random.default_rng(0)
    for k, v in w.items():
        for at in rng.integers(0, v.size, 6):
            near = []
            for step in (1e-5, -1e-5):
                moved = v.copy()
                moved.flat[at] += step
                near.append(training.gradients(a, b, w | {k: moved}, back=False)[0])
            assert grads[k].flat[at] == pytest.approx((near[0] - near[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_additive_kernel_by_loops():
    w = neural.random_weights(4, 6, 4, 4, 3, additive=True)
    query, seen = np.random.default_rng(2).normal(size=(2, 2, 3, 4))
    got = neural.scores(query, seen, w)
    want = [[[sum(w["scale"][u] * np.tanh(q[u] + s[u]) for u in range(4)) for s in seen[k]] for q in query[k]] for k in range(2)]
    assert np.allclose(got, want)
    assert len(neural.run(np.array([[1, 2, 0]]), w, 1, 2, 5)[0]) <= 5
    with pytest.raises(ValueError):
        neural.random_weights(4, 6, 3, 4, additive=True)


def test_sums_do_not_depend_on_partitions(spark):
    data = rows(40)
    w = neural.random_weights(4, 6, 40, 40)  # parts of more than one chunk
    assert any(v.size > training.CHUNK for v in w.values())
    loss, n, grads = training.gradients(*arrays(data), {k: v.astype(float) for k, v in w.items()})
    df = spark.createDataFrame([*data, (None, [1, 2, 0, 0, 0]), (data[0][0], None)], SCHEMA)
    for parts in (1, 5):
        one, places, got = training.summed(df.repartition(parts), w)
        assert places == n and one == pytest.approx(loss, rel=1e-4)
        assert all(np.allclose(got[k], grads[k], rtol=1e-2, atol=1e-3) for k in w)
    assert training.summed(df.limit(0), w) == (0, 0, {})


def test_adam_first_step():
    w = {"a": np.array([1.0, 2.0])}
    new = training.Adam(rate=0.1).apply(w, {"a": np.array([5.0, -0.5])})
    assert np.allclose(new["a"], [0.9, 2.1], atol=1e-5)  # a first step is as long as the rate


def test_learns_and_stops(spark, tmp_path):
    df = spark.createDataFrame(rows(60), SCHEMA).coalesce(2).cache()
    start = neural.random_weights(4, 6, 8, 16, 1)
    path = str(tmp_path / "best.npz")
    best, history = training.train(df, start, df, epochs=6, steps=2, optimizer=training.Adam(0.03), path=path)
    assert [h["epoch"] for h in history] == list(range(1, len(history) + 1))
    assert history[-1]["val_loss"] < 0.7 * history[0]["loss"]
    assert all((neural.load_weights(path)[k] == best[k]).all() for k in best)
    same, history = training.train(df, best, df, epochs=9, patience=2, optimizer=training.Adam(0.0))
    assert len(history) == 3 and all((same[k] == best[k]).all() for k in best)  # nothing gets better after the first
    assert training.train(df.limit(0), start)[1] == []
