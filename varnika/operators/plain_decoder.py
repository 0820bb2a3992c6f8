"""The first-generation encoder-decoder: two LSTMs without attention, trained by training.train().

Its inputs are one-hot letters whose every cell is embedded and flattened; a layer over that adds up to one row of gate inputs for each letter, which is
what the weights hold here. The decoder starts from the encoder's last state and, when it decodes, carries its state from step to step.
"""

from __future__ import annotations

import numpy as np

from . import neural
from .training import _lstm, _lstm_back, _softmax

#: Epochs without a better accuracy before training stops.
PATIENCE = 20


def random_weights(n_in: int, n_out: int, units: int = 32, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shape = {"enc_w": (n_in, 4 * units), "enc_r": (units, 4 * units), "enc_b": (4 * units,), "dec_w": (n_out, 4 * units), "dec_r": (units, 4 * units), "dec_b": (4 * units,), "out_w": (units, n_out), "out_b": (n_out,)}
    return {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in shape.items()}


def _one_hot(ids: np.ndarray, size: int, kind: np.dtype) -> np.ndarray:
    return np.eye(size, dtype=kind)[ids]


def _forward(ids_in: np.ndarray, before: np.ndarray, p: dict[str, np.ndarray]):
    kind = p["enc_r"].dtype
    zero = np.zeros((len(ids_in), p["enc_r"].shape[0]), kind)
    x, y = _one_hot(ids_in, len(p["enc_w"]), kind), _one_hot(before, len(p["dec_w"]), kind)
    seen, h, c, enc_tape = _lstm(x, zero, zero, p["enc_w"], p["enc_r"], p["enc_b"])
    states, _, _, dec_tape = _lstm(y, h, c, p["dec_w"], p["dec_r"], p["dec_b"])
    return x, y, seen, enc_tape, states, dec_tape, _softmax(states @ p["out_w"] + p["out_b"])


def gradients(ids_in: np.ndarray, ids_out: np.ndarray, p: dict[str, np.ndarray], back: bool = True):
    """(summed loss, number of places, gradients of the sum), with the true previous token as the decoder's input; padding (0) adds nothing, but counts."""
    before, after = ids_out[:, :-1], ids_out[:, 1:]
    x, y, seen, enc_tape, states, dec_tape, chance = _forward(ids_in, before, p)
    used = after != 0
    rows, steps = np.indices(after.shape)
    loss = float(-(np.log(np.maximum(chance[rows, steps, after], 1e-30)) * used).sum())
    if not back:
        return loss, after.size, {}
    chance[rows, steps, after] -= 1
    chance *= used[:, :, None]
    d = {"out_w": np.einsum("btu,btv->uv", states, chance), "out_b": chance.sum(axis=(0, 1))}
    zero = np.zeros_like(seen[:, 0])
    _, dh, dc, d["dec_w"], d["dec_r"], d["dec_b"] = _lstm_back(chance @ p["out_w"].T, zero, zero, y, dec_tape, p["dec_w"], p["dec_r"])
    _, _, _, d["enc_w"], d["enc_r"], d["enc_b"] = _lstm_back(np.zeros_like(seen), dh, dc, x, enc_tape, p["enc_w"], p["enc_r"])
    return loss, after.size, d


def misses(ids_in: np.ndarray, ids_out: np.ndarray, p: dict[str, np.ndarray], back: bool = False):
    """(wrong places, places, {}): with it as metric, training keeps the weights of greatest accuracy. Padding is no place."""
    after = ids_out[:, 1:]
    chance = _forward(ids_in, ids_out[:, :-1], p)[-1]
    used = after != 0
    return float(((chance.argmax(axis=2) != after) & used).sum()), int(used.sum()), {}


def run(ids: np.ndarray, p: dict[str, np.ndarray], start: int, end: int, steps: int = neural.STEPS_OUT) -> list[list[int]]:
    """Token ids for each row of padded input ids, greedily; a row ends at `end`."""
    h = c = np.zeros((len(ids), p["enc_r"].shape[0]), p["enc_r"].dtype)
    for t in range(ids.shape[1]):
        h, c = neural._cell(_one_hot(ids[:, t], len(p["enc_w"]), h.dtype), h, c, p["enc_w"], p["enc_r"], p["enc_b"])
    token, done, out = np.full(len(ids), start), np.zeros(len(ids), bool), [[] for _ in ids]
    for _ in range(steps):
        h, c = neural._cell(_one_hot(token, len(p["dec_w"]), h.dtype), h, c, p["dec_w"], p["dec_r"], p["dec_b"])
        token = (h @ p["out_w"] + p["out_b"]).argmax(axis=1)
        for k in np.flatnonzero(~done):
            out[k].append(int(token[k]))
        done |= token == end
        if done.all():
            break
    return out
