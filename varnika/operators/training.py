"""Training of the encoder-decoder of neural.py: gradients in numpy over Arrow batches, added up by Spark, applied by the driver.

A step is one job over the rows of one mini-batch. Each task adds the gradients of its rows up; these sums are cut into chunks of `CHUNK` numbers and
added by chunk, so no task and not the driver ever holds more than one set of gradients, however many rows or tasks there are.
A lost executor costs the recomputation of its rows: the only state, weights and moments, is the driver's and as large as the model.
"""

from __future__ import annotations

import io
import json
import logging
import re
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neural

CHUNK = 4096
PARTS = "part string, at int, loss double, n long, grad binary"
log = logging.getLogger(__name__)


def _lstm(x: np.ndarray, h: np.ndarray, c: np.ndarray, w: np.ndarray, r: np.ndarray, b: np.ndarray):
    """All hidden states (rows, steps, units), the last state, and what the way back needs."""
    seen, tape = [], []
    for t in range(x.shape[1]):
        i, f, g, o = np.split(x[:, t] @ w + h @ r + b, 4, axis=-1)
        i, f, g, o = neural._sigmoid(i), neural._sigmoid(f), np.tanh(g), neural._sigmoid(o)
        new = f * c + i * g
        tape.append((i, f, g, o, h, c, np.tanh(new)))
        h, c = o * tape[-1][-1], new
        seen.append(h)
    return np.stack(seen, axis=1), h, c, tape


def _lstm_back(d_seen: np.ndarray, dh: np.ndarray, dc: np.ndarray, x: np.ndarray, tape: list, w: np.ndarray, r: np.ndarray):
    """Gradients of inputs, weights and first state; dh and dc are those of the last state, d_seen those of each step."""
    dx, dw, dr, db = np.zeros_like(x), np.zeros_like(w), np.zeros_like(r), np.zeros(w.shape[1], w.dtype)
    for t in reversed(range(x.shape[1])):
        i, f, g, o, h, c, top = tape[t]
        dh = dh + d_seen[:, t]
        dc = dc + dh * o * (1 - top * top)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - g * g), dh * top * o * (1 - o)], axis=1)
        dx[:, t], dh, dc = dz @ w.T, dz @ r.T, dc * f
        dw += x[:, t].T @ dz
        dr += h.T @ dz
        db += dz.sum(axis=0)
    return dx, dh, dc, dw, dr, db


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def gradients(ids_in: np.ndarray, ids_out: np.ndarray, p: dict[str, np.ndarray], back: bool = True):
    """(summed loss, number of places, gradients of the sum) with the true previous token as the decoder's input.

    A place is a row's target token; one that is padding (0) adds nothing to the loss, but counts. back=False leaves the gradients out.
    """
    before, after = ids_out[:, :-1], ids_out[:, 1:]
    zero = np.zeros((len(ids_in), p["enc_r"].shape[0]), p["enc_r"].dtype)
    x = p["enc_embed"][ids_in]
    seen, h, c, enc_tape = _lstm(x, zero, zero, p["enc_w"], p["enc_r"], p["enc_b"])
    e = p["dec_embed"][before]
    query = neural.queries(e, p)
    weight = _softmax(neural.scores(query, seen, p))
    context = weight @ seen
    both = np.concatenate([context, e], axis=2)
    states, _, _, dec_tape = _lstm(both, h, c, p["dec_w"], p["dec_r"], p["dec_b"])
    chance = _softmax(states @ p["out_w"] + p["out_b"])
    used = after != 0
    rows, steps = np.indices(after.shape)
    loss = float(-(np.log(np.maximum(chance[rows, steps, after], 1e-30)) * used).sum())
    if not back:
        return loss, after.size, {}
    d = {k: np.zeros_like(v) for k, v in p.items()}
    chance[rows, steps, after] -= 1
    chance *= used[:, :, None]
    d["out_w"] = np.einsum("btu,btv->uv", states, chance)
    d["out_b"] = chance.sum(axis=(0, 1))
    d_both, dh, dc, d["dec_w"], d["dec_r"], d["dec_b"] = _lstm_back(chance @ p["out_w"].T, np.zeros_like(zero), np.zeros_like(zero), both, dec_tape, p["dec_w"], p["dec_r"])
    units = seen.shape[2]
    d_context, d_e = d_both[:, :, :units], d_both[:, :, units:].copy()
    d_seen = weight.transpose(0, 2, 1) @ d_context
    d_weight = d_context @ seen.transpose(0, 2, 1)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=2, keepdims=True))
    if "scale" in p:
        z = np.tanh(query[:, :, None] + seen[:, None])
        d["scale"] = np.einsum("bts,btsu->u", d_score, z)
        dz = d_score[..., None] * p["scale"] * (1 - z * z)
        d_query = dz.sum(axis=2)
        d_seen += dz.sum(axis=1)
        d_e += d_query
    else:
        d_query = d_score @ seen
        d_seen += d_score.transpose(0, 2, 1) @ query
        d["query_w"] = np.einsum("bte,btu->eu", e, d_query)
        d["query_b"] = d_query.sum(axis=(0, 1))
        d_e += d_query @ p["query_w"].T
    dx, _, _, d["enc_w"], d["enc_r"], d["enc_b"] = _lstm_back(d_seen, dh, dc, x, enc_tape, p["enc_w"], p["enc_r"])
    np.add.at(d["enc_embed"], ids_in, dx)
    np.add.at(d["dec_embed"], before, d_e)
    return loss, after.size, d


def summed(pairs: DataFrame, weights: dict[str, np.ndarray], back: bool = True, model: Callable = gradients) -> tuple[float, int, dict[str, np.ndarray]]:
    """model (gradients() or one of its kind) over all rows of pairs (ids_in, ids_out: arrays of ids, each of one length in all rows). Rows with a null array are left out.

    Weights go to each executor once, as a broadcast as large as the model, and leave it when the sum is there.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, n, total, own = 0.0, 0, {}, shared.value
        for batch in batches:
            one, places, grad = model(np.stack(batch["ids_in"]).astype(np.int64), np.stack(batch["ids_out"]).astype(np.int64), own, back)
            loss, n = loss + one, n + places
            for k, v in grad.items():
                total[k] = total[k] + v if k in total else v.astype(np.float64)
        if n:
            rows = [("", 0, loss, n, None)]
            for k, v in total.items():
                flat = v.ravel()
                rows += [(k, at, 0.0, 0, flat[at * CHUNK : (at + 1) * CHUNK].tobytes()) for at in range(-(-len(flat) // CHUNK))]
            yield pd.DataFrame(rows, columns=["part", "at", "loss", "n", "grad"])

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, n, total = 0.0, 0, None
        for batch in batches:
            loss, n = loss + float(batch["loss"].sum()), n + int(batch["n"].sum())
            for g in batch["grad"].dropna():
                total = np.frombuffer(g) + (0 if total is None else total)
        yield pd.DataFrame([(*key, loss, n, None if total is None else total.tobytes())], columns=["part", "at", "loss", "n", "grad"])

    some = pairs.select("ids_in", "ids_out").filter("ids_in is not null and ids_out is not null")
    each = some.mapInPandas(task, PARTS)
    try:
        got = each.groupBy("part", "at").applyInPandas(add, PARTS).collect()  # one set of gradients
    finally:
        shared.destroy()
    loss, n = sum(r.loss for r in got), sum(r.n for r in got)
    parts: dict[str, list] = {}
    for r in sorted((r for r in got if r.part), key=lambda r: (r.part, r.at)):
        parts.setdefault(r.part, []).append(np.frombuffer(r.grad))
    return loss, n, {k: np.concatenate(v).reshape(weights[k].shape) for k, v in parts.items()}


class Adam:
    """The usual rule: means of gradients and of their squares, both corrected for their start at zero."""

    def __init__(self, rate: float = 0.001, first: float = 0.9, second: float = 0.999, least: float = 1e-7):
        self.rate, self.first, self.second, self.least = rate, first, second, least
        self.steps, self.mean, self.square = 0, {}, {}

    def apply(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.steps += 1
        rate = self.rate * np.sqrt(1 - self.second**self.steps) / (1 - self.first**self.steps)
        new = dict(weights)
        for k, g in grads.items():
            self.mean[k] = self.first * self.mean.get(k, 0.0) + (1 - self.first) * g
            self.square[k] = self.second * self.square.get(k, 0.0) + (1 - self.second) * g * g
            new[k] = (weights[k] - rate * self.mean[k] / (np.sqrt(self.square[k]) + self.least)).astype(weights[k].dtype)
        return new


class RMSprop:
    """A step over the root of the running mean of squared gradients. With decay, the rate falls at the start of each epoch from the second on."""

    def __init__(self, rate: float = 0.001, keep: float = 0.9, least: float = 1e-7, decay: float = 0.0):
        self.rate, self.keep, self.least, self.decay = rate, keep, least, decay
        self.steps, self.mean, self.square = 0, {}, {}

    def begin(self, epoch: int) -> None:
        self.rate /= 1 + self.decay * epoch

    def apply(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.steps += 1
        new = dict(weights)
        for k, g in grads.items():
            self.square[k] = self.keep * self.square.get(k, 0.0) + (1 - self.keep) * g * g
            new[k] = (weights[k] - self.rate * g / (np.sqrt(self.square[k]) + self.least)).astype(weights[k].dtype)
        return new


class Checkpoints:
    """Versions of a training's state in a folder that all machines share: one file each, written under another name and committed by renaming it, so a version is whole or not there.

    A state holds weights, the best weights, the optimizer's moments and numbers, and the course of training; it goes through the driver, as large as a few models.
    """

    def __init__(self, folder: str, keep: int = 2):
        from pyarrow import fs

        self.files, self.folder = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.keep = keep

    def versions(self) -> list[int]:
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted(int(m[1]) for m in (re.fullmatch(r"epoch-([0-9]+)[.]npz", x.base_name) for x in found) if m)

    def _path(self, version: int) -> str:
        return f"{self.folder}/epoch-{version:06d}.npz"

    def save(self, version: int, arrays: dict[str, dict[str, np.ndarray]], rest: dict) -> None:
        flat = {f"{group}/{k}": v for group, some in arrays.items() for k, v in some.items()}
        data = io.BytesIO()
        np.savez(data, **flat, rest=np.frombuffer(json.dumps(rest).encode(), np.uint8))
        self.files.create_dir(self.folder, recursive=True)
        unfinished = f"{self.folder}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(unfinished) as f:
            f.write(data.getvalue())
        self.files.move(unfinished, self._path(version))
        for old in self.versions()[: -self.keep]:
            self.files.delete_file(self._path(old))

    def last(self) -> tuple[int, dict[str, dict[str, np.ndarray]], dict] | None:
        """(version, arrays, rest) of the latest version, if there is any."""
        found = self.versions()
        if not found:
            return None
        with self.files.open_input_stream(self._path(found[-1])) as f, np.load(io.BytesIO(f.read())) as data:
            arrays: dict[str, dict[str, np.ndarray]] = {}
            for name in data.files:
                group, _, k = name.partition("/")
                if k:
                    arrays.setdefault(group, {})[k] = data[name]
            return found[-1], arrays, json.loads(data["rest"].tobytes())


def train(pairs: DataFrame, weights: dict[str, np.ndarray], valid: DataFrame | None = None, epochs: int = 10, steps: int = 1, patience: int = 5, optimizer: Adam | RMSprop | None = None, path: str | None = None, checkpoints: str | None = None, model: Callable = gradients, metric: Callable | None = None) -> tuple[dict[str, np.ndarray], list[dict]]:
    """(best weights, one dict (epoch, loss, val_loss, seconds) per epoch).

    An epoch has `steps` mini-batches, to which a hash of the ids deals the rows; a table partitioned by a column `batch` (0 .. steps - 1; see batches.write_batches)
    has its own deal, and a step then reads only its part. Weights are best at the least loss on valid (without it: on pairs); training stops after `patience`
    epochs without a better one. `metric`, a function like model, gives val_loss in the loss's place. With path, the best weights are written there as .npz whenever they change.
    With checkpoints, a folder, the state is saved after each epoch, and a later call goes on from the last one, to the same weights as if it hadn't been interrupted. Without any row, weights stay.
    """
    optimizer = optimizer or Adam()
    batch = F.col("batch") if "batch" in pairs.columns else F.pmod(F.xxhash64("ids_in", "ids_out"), F.lit(steps))
    best, least, since, history, after = weights, float("inf"), 0, [], 0
    saved = Checkpoints(checkpoints) if checkpoints else None
    if saved and (found := saved.last()):
        after, arrays, rest = found
        weights, best = arrays["weights"], arrays["best"]
        optimizer.mean, optimizer.square = arrays.get("mean", {}), arrays.get("square", {})
        optimizer.steps, optimizer.rate, least, since, history = (rest[k] for k in ("steps", "rate", "least", "since", "history"))
    for epoch in range(after + 1, epochs + 1):
        if since >= patience:
            break
        if epoch > 1 and hasattr(optimizer, "begin"):
            optimizer.begin(epoch - 1)
        began, loss, n = time.monotonic(), 0.0, 0
        for k in range(steps):
            one, places, grads = summed(pairs.filter(batch == k), weights, model=model)
            loss, n = loss + one, n + places
            if places:
                weights = optimizer.apply(weights, {name: g / places for name, g in grads.items()})
        if not n:
            return best, history
        loss /= n
        held, places, _ = summed(valid, weights, False, metric or model) if valid is not None else (loss, 1, {})
        val_loss = held / places if places else loss
        history.append({"epoch": epoch, "loss": loss, "val_loss": val_loss, "seconds": time.monotonic() - began})
        log.info("epoch %d: loss %.4f, held out %.4f, %.1f s", *history[-1].values())
        if val_loss < least:
            best, least, since = weights, val_loss, 0
            if path:
                neural.save_weights(path, best)
        else:
            since += 1
        if saved:
            moments = {"mean": optimizer.mean, "square": optimizer.square}
            saved.save(epoch, {"weights": weights, "best": best} | moments, {"steps": optimizer.steps, "rate": optimizer.rate, "least": least, "since": since, "history": history})
    return best, history
