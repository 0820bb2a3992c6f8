"""A character encoder-decoder with attention, in numpy over Arrow batches.

The encoder is an embedding and an LSTM; the decoder embeds the previous token, attends from that embedding (through a dense layer) to all
encoder steps, and feeds context and embedding to an LSTM cell and an output layer. Decoding is greedy or a beam search, up to a fixed number of steps.
Attention is by dot product; with weights that hold `scale`, it is additive, and the embedding itself, then as wide as a state, is the query.
Weights are arrays of an .npz file, which `SparkContext.addFile` ships; each Python worker loads it once.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS_IN, STEPS_OUT = 47, 173
#: Numbers of a table of contexts at most: more rows are decoded in parts.
TABLE = 1 << 24
log = logging.getLogger("varnika")
_loaded: dict[str, dict] = {}


def random_weights(n_in: int, n_out: int, embed: int = 16, units: int = 32, seed: int = 0, additive: bool = False) -> dict[str, np.ndarray]:
    if additive and embed != units:
        raise ValueError("additive attention needs embeddings as wide as the states")
    rng = np.random.default_rng(seed)
    shape = {
        "enc_embed": (n_in, embed), "enc_w": (embed, 4 * units), "enc_r": (units, 4 * units), "enc_b": (4 * units,), "dec_embed": (n_out, embed), "query_w": (embed, units), "query_b": (units,),
        "dec_w": (units + embed, 4 * units), "dec_r": (units, 4 * units), "dec_b": (4 * units,), "out_w": (units, n_out), "out_b": (n_out,),
    }
    if additive:
        shape = {k: v for k, v in shape.items() if not k.startswith("query")} | {"scale": (units,)}
    return {k: rng.normal(0, 0.5, s).astype(np.float32) for k, s in shape.items()}


def save_weights(path: str, weights: dict[str, np.ndarray]) -> None:
    np.savez(path, **weights)


def load_weights(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k] for k in f.files}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _cell(x, h, c, w, r, b):
    i, f, g, o = np.split(x @ w + h @ r + b, 4, axis=-1)
    c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
    return _sigmoid(o) * np.tanh(c), c


def queries(e: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """What attends: embeddings (rows, steps, embed) through the dense layer, if there is one."""
    return e if "scale" in p else e @ p["query_w"] + p["query_b"]


def scores(query: np.ndarray, seen: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """How well each query fits each encoder step: (rows, steps, encoder steps)."""
    if "scale" in p:
        return np.tanh(query[:, :, None] + seen[:, None]) @ p["scale"]
    return query @ seen.transpose(0, 2, 1)


class Contexts:
    """What the decoder attends to after each token of each row. It depends on the row and the previous token alone, so it is computed once for each pair that occurs, whatever the step or hypothesis."""

    def __init__(self, seen: np.ndarray, p: dict[str, np.ndarray]):
        self.seen, self.p, self.tokens = seen, p, len(p["dec_embed"])
        self.table = np.empty((len(seen), self.tokens, seen.shape[2]), seen.dtype)
        self.known = np.zeros((len(seen), self.tokens), bool)

    def of(self, rows: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        new = ~self.known[rows, tokens]
        if new.any():
            r, t = np.divmod(np.unique(rows[new] * self.tokens + tokens[new]), self.tokens)
            fit = scores(queries(self.p["dec_embed"][t][:, None], self.p), self.seen[r], self.p)[:, 0]
            fit = np.exp(fit - fit.max(axis=1, keepdims=True))
            self.table[r, t] = np.einsum("bt,btu->bu", fit / fit.sum(axis=1, keepdims=True), self.seen[r])
            self.known[r, t] = True
        return self.table[rows, tokens]


def encoded(ids: np.ndarray, p: dict[str, np.ndarray]) -> tuple[Contexts, np.ndarray, np.ndarray]:
    """The contexts of padded input ids, and the encoder's last state. Pads take part like other ids."""
    units = p["enc_r"].shape[0]
    h = c = np.zeros((len(ids), units), np.float32)
    x, seen = p["enc_embed"][ids], np.empty((len(ids), ids.shape[1], units), np.float32)
    for t in range(ids.shape[1]):
        h, c = _cell(x[:, t], h, c, p["enc_w"], p["enc_r"], p["enc_b"])
        seen[:, t] = h
    return Contexts(seen, p), h, c


def _parts(ids: np.ndarray, p: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
    """Rows whose contexts have about TABLE numbers."""
    step = max(1, TABLE // (len(p["dec_embed"]) * p["enc_r"].shape[0]))
    return (ids[i : i + step] for i in range(0, len(ids), step))


def _step(near: Contexts, rows: np.ndarray, token: np.ndarray, h: np.ndarray, c: np.ndarray, p: dict[str, np.ndarray]):
    """Logits of the next token, and the new state."""
    h, c = _cell(np.concatenate([near.of(rows, token), p["dec_embed"][token]], axis=1), h, c, p["dec_w"], p["dec_r"], p["dec_b"])
    return h @ p["out_w"] + p["out_b"], h, c


def decode(ids: np.ndarray, weights: dict[str, np.ndarray], start: int, end: int, steps: int = STEPS_OUT, until: float | None = None) -> list[tuple[list[int], str]]:
    """(token ids, status) of each row, greedily. Status: ok (it came to `end`), unfinished (`steps` tokens without it) or timeout (time.monotonic() went past `until` before)."""
    out: list[tuple[list[int], str]] = []
    for part in _parts(ids, weights):
        late = until is not None and time.monotonic() > until
        made: list[list[int]] = [[] for _ in part]
        done = np.zeros(len(part), bool)
        if not late:
            near, h, c = encoded(part, weights)
            token, rows = np.full(len(part), start), np.arange(len(part))
            for _ in range(steps):
                logits, h, c = _step(near, rows, token, h, c, weights)
                token = logits.argmax(axis=1)
                for k in np.flatnonzero(~done):
                    made[k].append(int(token[k]))
                done |= token == end
                late = until is not None and time.monotonic() > until
                if done.all() or late:
                    break
        out += [(m, "ok" if d else "timeout" if late and len(m) < steps else "unfinished") for m, d in zip(made, done, strict=True)]
    return out


def run(ids: np.ndarray, weights: dict[str, np.ndarray], start: int, end: int, steps: int = STEPS_OUT) -> list[list[int]]:
    """Token ids for each row of padded input ids; a row ends at `end`."""
    return [made for made, _ in decode(ids, weights, start, end, steps)]


def _top(values: np.ndarray, width: int) -> np.ndarray:
    """Places of the `width` greatest of each row, greatest first, equal ones in order."""
    return np.argsort(-values, axis=1, kind="stable")[:, :width]


def beams(ids: np.ndarray, weights: dict[str, np.ndarray], start: int, end: int, k: int, steps: int = STEPS_OUT, width: int | None = None) -> list[list[tuple[float, list[int]]]]:
    """Up to k (score, token ids) of each row, best first, equal scores by tokens: beam search over all rows at once.

    The `width` (default: k) likeliest continuations of a row's open hypotheses go on at each step; those that come to `end` are set aside. The score is the mean
    log probability of the tokens, `end` included. A hypothesis that can't reach the k-th score any more is dropped. With a width of 1 this is run().
    """
    p, width, out = weights, width or k, []
    for part in _parts(ids, weights):
        near, h, c = encoded(part, p)
        n, rows = len(part), np.arange(len(part))
        found: list[list[tuple[float, list[int]]]] = [[] for _ in range(n)]
        token, total, made = np.full(n, start), np.zeros(n), np.zeros((n, 0), np.int64)
        for t in range(1, steps + 1):
            if not len(rows):
                break
            logits, h, c = _step(near, rows, token, h, c, p)
            x = logits.astype(np.float64)
            x -= x.max(axis=1, keepdims=True)
            x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
            at = np.arange(len(rows)) - np.searchsorted(rows, rows)  # place among the row's hypotheses
            whole = np.full((n, at.max() + 1, x.shape[1]), -np.inf)
            whole[rows, at] = total[:, None] + x
            flat = whole.reshape(n, -1)
            best = _top(flat, width)
            row, value = np.repeat(np.arange(n), best.shape[1]), np.take_along_axis(flat, best, axis=1).ravel()
            some = np.isfinite(value)
            row, value, slot = row[some], value[some], best.ravel()[some]
            parent, token = np.searchsorted(rows, row) + slot // x.shape[1], slot % x.shape[1]
            made = np.concatenate([made[parent], token[:, None]], axis=1)
            for i in np.flatnonzero(token == end):
                found[row[i]].append((float(value[i]) / t, made[i].tolist()))
            for r in np.unique(row[token == end]):
                found[r] = sorted(found[r], key=lambda f: (-f[0], f[1]))[:k]
            bar = np.array([f[k - 1][0] if len(f) >= k else -np.inf for f in found])
            going = (token != end) & (value / steps >= bar[row])
            rows, total, token, made = row[going], value[going], token[going], made[going]
            h, c = h[parent[going]], c[parent[going]]
        for i, r in enumerate(rows):
            found[r].append((float(total[i]) / steps, made[i].tolist()))
        out += [sorted(f, key=lambda f: (-f[0], f[1]))[:k] for f in found]
    return out


def _ids(words: list[str], vocab_in: dict[str, int], steps_in: int) -> np.ndarray:
    """The last steps_in ids of each word, zeros after a shorter one."""
    ids = np.zeros((len(words), steps_in), np.int64)
    for k, w in enumerate(words):
        tail = [vocab_in[ch] for ch in w][-steps_in:]
        ids[k, : len(tail)] = tail
    return ids


def _known(words: list[str], vocab_in: dict[str, int]) -> list[str]:
    return [w for w in dict.fromkeys(words) if all(ch in vocab_in for ch in w)]


def _text(out: list[int], letters: dict[int, str]) -> str:
    return "".join(letters.get(i, "") for i in out if i).strip("$")


def spell(words: list[str], weights, vocab_in: dict[str, int], vocab_out: dict[str, int], steps_in: int = STEPS_IN, steps: int = STEPS_OUT) -> dict[str, str]:
    """Each distinct word's output; a word with an unknown character gives the empty string."""
    known, letters = _known(words, vocab_in), {i: ch for ch, i in vocab_out.items()}
    got = run(_ids(known, vocab_in, steps_in), weights, vocab_out["^"], vocab_out["$"], steps) if known else []
    made = {w: _text(out, letters) for w, out in zip(known, got, strict=True)}
    return {w: made.get(w, "") for w in words}


def spell_checked(words: list[str], weights, vocab_in: dict[str, int], vocab_out: dict[str, int], steps_in: int = STEPS_IN, steps: int = STEPS_OUT, seconds: float | None = None) -> dict[str, tuple[str, str]]:
    """(text, status) of each distinct word: ok; unfinished (the text so far); oov (an unknown character), error or timeout (not done within `seconds` of the call), all with the empty text.

    If decoding the words together fails, each is decoded alone, so a word that can't be decoded costs no other its result.
    """
    known, letters = _known(words, vocab_in), {i: ch for ch, i in vocab_out.items()}
    until = None if seconds is None else time.monotonic() + seconds
    out: dict[str, tuple[str, str]] = {w: ("", "oov") for w in words}

    def settle(some: list[str]) -> None:
        got = decode(_ids(some, vocab_in, steps_in), weights, vocab_out["^"], vocab_out["$"], steps, until)
        out.update({w: ("" if status == "timeout" else _text(made, letters), status) for w, (made, status) in zip(some, got, strict=True)})

    try:
        settle(known)
    except Exception:  # noqa: BLE001
        for w in known:
            try:
                settle([w])
            except Exception as fault:  # noqa: BLE001
                log.error("not able to spell a word of %d characters: %s", len(w), fault)
                out[w] = ("", "error")
    return out


def spell_k_best(words: list[str], weights, vocab_in: dict[str, int], vocab_out: dict[str, int], k: int = 5, steps_in: int = STEPS_IN, steps: int = STEPS_OUT, width: int | None = None) -> dict[str, list[tuple[str, float]]]:
    """Up to k (text, score) of each distinct word, best first; a text that several token sequences give counts once. None for a word with an unknown character."""
    known, letters = _known(words, vocab_in), {i: ch for ch, i in vocab_out.items()}
    got = beams(_ids(known, vocab_in, steps_in), weights, vocab_out["^"], vocab_out["$"], k, steps, width) if known else []
    out: dict[str, list[tuple[str, float]]] = {w: [] for w in words}
    for w, found in zip(known, got, strict=True):
        best: dict[str, float] = {}
        for score, made in found:
            best.setdefault(_text(made, letters), score)
        out[w] = list(best.items())
    return out


def _weights(path: str) -> dict[str, np.ndarray]:
    """The weights file of that name, shipped by addFile; loaded once in each worker."""
    from pyspark import SparkFiles

    where = SparkFiles.get(path.rpartition("/")[2])
    if where not in _loaded:
        _loaded[where] = load_weights(where)
    return _loaded[where]


def transliterator(path: str, vocab_in: dict[str, int], vocab_out: dict[str, int], steps_in: int = STEPS_IN, steps: int = STEPS_OUT):
    """A pandas UDF text -> text with the weights file of that name (shipped by addFile). Words of a batch are decoded together, once each."""

    @F.pandas_udf("string")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = _weights(path)
        for texts in batches:
            words = [w for t in texts.dropna() for w in t.split(" ")]
            made = spell(words, weights, vocab_in, vocab_out, steps_in, steps)
            yield texts.map(lambda t, m=made: " ".join(m[w] for w in t.split(" ")), na_action="ignore")

    return each


#: Fixed order: a text has the first of these that one of its words has.
STATUS = ("error", "timeout", "oov", "unfinished", "ok")


def checked_transliterator(path: str, vocab_in: dict[str, int], vocab_out: dict[str, int], steps_in: int = STEPS_IN, steps: int = STEPS_OUT, seconds: float | None = 10.0):
    """A pandas UDF text -> (text, status) as spell_checked() gives them for the words of a batch, with `seconds` for each batch. A null text has status null."""

    @F.pandas_udf("text string, status string")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = _weights(path)
        for texts in batches:
            words = [w for t in texts.dropna() for w in t.split(" ")]
            made = spell_checked(words, weights, vocab_in, vocab_out, steps_in, steps, seconds)
            rows = []
            for t in texts:
                got = [made[w] for w in t.split(" ")] if isinstance(t, str) else []
                rows.append((" ".join(x for x, _ in got), min((s for _, s in got), key=STATUS.index, default="null")))
            yield pd.DataFrame(rows, columns=["text", "status"])

    return each


def k_best(words: DataFrame, word: str, path: str, vocab_in: dict[str, int], vocab_out: dict[str, int], k: int = 5, steps_in: int = STEPS_IN, steps: int = STEPS_OUT, width: int | None = None) -> DataFrame:
    """(word, guess, score, rank) of each row of words: its k best spellings by beam search. None for null words and those with an unknown character.

    Words that repeat are decoded again, except within a batch: give distinct ones.
    """

    @F.pandas_udf("array<struct<guess:string,score:double>>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = _weights(path)
        for b in batches:
            made = spell_k_best(list(b.dropna()), weights, vocab_in, vocab_out, k, steps_in, steps, width)
            yield pd.Series([[{"guess": g, "score": s} for g, s in made[w]] if isinstance(w, str) else None for w in b], dtype=object)

    found = words.select(F.col(word).alias(word), F.posexplode(each(F.col(word))).alias("_at", "_g"))
    return found.select(word, "_g.guess", "_g.score", (F.col("_at") + 1).alias("rank"))
