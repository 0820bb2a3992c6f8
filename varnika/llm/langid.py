"""Language identification by a linear-chain conditional random field over words.

Each word scores each language by hashed features: prefixes, suffixes, byte n-grams with word ends, and the word itself if it is in the
lexicon of frequent training words. Transitions between the languages of neighbouring words are learned with the feature weights, by
gradient steps on the conditional likelihood, from training texts spliced into code-switched sequences. Forward-backward
gives each word's language distribution; a text's language is the one with the greatest expected number of words.
Words of over `WIDTH` bytes, as in text without spaces, count as several: parts of at most so many bytes, cut between characters.
A text is one chain, however long. It is worked off in segments of `CHAIN` words side by side: what the words of a segment do to a message
that passes them is a matrix, so messages first go from segment to segment, and then through all segments at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, keep, tidy

#: Bounds of the training sample: documents of each language, and windows of so many words from each.
DOCS_PER_LANG, WINDOWS, WINDOW_WORDS = 300, 6, 24
CHAIN, BITS, WIDTH, LIMIT = 64, 15, 24, 400_000
_odd = np.random.default_rng(3).integers(1, 1 << 62, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def plain(token: str) -> str:
    """The token in lower case, from its first to its last letter; empty if it has none."""
    if token.isalpha():
        return token.lower()
    at = [i for i, c in enumerate(token) if c.isalpha()]
    return token[at[0] : at[-1] + 1].lower() if at else ""


def parts(token: str) -> list[str]:
    """The plain token as words of at most WIDTH bytes and nearly equal length; none if it has no letter. Parts without one are left out."""
    word = plain(token)
    raw = word.encode("utf-8", "surrogatepass")
    if len(raw) <= WIDTH:
        return [word] if word else []
    out, at = [], 0
    while at < len(raw):
        left = len(raw) - at
        end = at - -left // -(-left // WIDTH)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end].decode("utf-8", "surrogatepass"))
        at = end
    return [w for w in out if any(map(str.isalpha, w))]


def word_hash(words: list[str]) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = 1469598103934665603
        for b in w.encode("utf-8", "surrogatepass"):
            h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return out


def features(words: list[str], lexicon: np.ndarray) -> np.ndarray:
    """Feature indices of each word of at most WIDTH bytes, one row each; 2**BITS stands for none."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    n = np.array([len(b) for b in raw])
    data = np.frombuffer(b"".join(b"\x02" + b.ljust(WIDTH + 1, b"\0") for b in raw), np.uint8).reshape(len(words), WIDTH + 2).astype(np.uint64)
    data[np.arange(len(words)), n + 1] = 3
    none, columns = 1 << BITS, []

    def add(kind: int, grams: list[np.ndarray], fits: np.ndarray) -> None:
        h = np.full(grams[0].shape, kind, np.uint64) * _odd[0]
        for k, g in enumerate(grams):
            h = (h ^ (h >> np.uint64(29))) * _odd[k + 1] + g * _odd[k + 9]
        h = (h ^ (h >> np.uint64(32))) * _odd[20]
        columns.append(np.where(fits, (h >> np.uint64(64 - BITS)).astype(np.int32), none))

    row = np.arange(len(words))
    for k in (1, 2, 3):
        add(k, [data[:, 1 + j : 2 + j] for j in range(k)], (n >= k)[:, None])
        add(10 + k, [data[row, np.maximum(n - j, 0)][:, None] for j in range(k)], (n >= k)[:, None])
    for k in (2, 3, 4):
        starts = WIDTH + 3 - k
        add(20 + k, [data[:, j : j + starts] for j in range(k)], np.arange(starts)[None, :] + k <= (n + 2)[:, None])
    if len(lexicon):
        h = word_hash(words)
        known = lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h
        add(30, [h[:, None]], known[:, None])
    return np.concatenate(columns, axis=1).astype(np.int32)


def forward_backward(scores: np.ndarray, length: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None):
    """Marginals (chains, steps, labels) from emission scores, and summed pair marginals if asked. Steps beyond a chain's length are 0.

    before: the forward message (chains, labels) of the word before each chain, negative where there is none; after: the backward message of its last word.
    """
    c, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(trans - trans.max())
    alpha, beta = np.empty((t, c, k), e.dtype), np.ones((t, c, k), e.dtype)
    first = np.exp(start - start.max())
    now = (first if before is None else np.where(before[:, :1] < 0, first, before @ a)) * e[:, 0]
    alpha[0] = now / now.sum(axis=1, keepdims=True)
    for i in range(1, t):
        now = (alpha[i - 1] @ a) * e[:, i]
        alpha[i] = now / now.sum(axis=1, keepdims=True)
    last = np.ones(k, e.dtype) if after is None else after
    beta[t - 1] = last
    for i in range(t - 2, -1, -1):
        now = (e[:, i + 1] * beta[i + 1]) @ a.T
        now /= now.sum(axis=1, keepdims=True)
        beta[i] = np.where((i + 1 < length)[:, None], now, last)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    gamma *= (np.arange(t)[:, None] < length[None, :])[:, :, None]
    if not pairs:
        return gamma.transpose(1, 0, 2), None
    xi = np.zeros((k, k))
    for i in range(t - 1):
        both = alpha[i][:, :, None] * a[None] * (e[:, i + 1] * beta[i + 1])[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        xi += both[i + 1 < length].sum(axis=0)
    return gamma.transpose(1, 0, 2), xi


def messages(scores: np.ndarray, length: np.ndarray, of: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, after) of the segments of some texts, for forward_backward; `of` numbers the texts, whose segments come in order, all but the last of them full."""
    n, t, k = scores.shape
    e = np.exp(scores.astype(np.float64) - scores.max(axis=2, keepdims=True))
    a = np.exp((trans - trans.max()).astype(np.float64))
    opens = np.ones(n, bool)
    opens[1:] = of[1:] != of[:-1]
    first = np.exp(start - start.max())
    # row i of a segment's matrix: the message after its last word, if the word before it had label i for certain
    moved = np.where(opens[:, None, None], first, a) * e[:, None, 0]
    for i in range(1, t):
        moved /= moved.sum(axis=(1, 2), keepdims=True)
        moved = np.where((i < length)[:, None, None], (moved @ a) * e[:, None, i], moved)
    moved /= moved.sum(axis=(1, 2), keepdims=True)
    before, after = np.full((n, k), -1.0), np.ones((n, k))
    place = np.arange(n) - np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    order = np.argsort(place, kind="stable")
    cuts = np.cumsum(np.bincount(place))
    for here in np.split(order, cuts[:-1])[1:]:  # the second segments of all texts, the third, ...
        past = np.where(before[here - 1, :1] < 0, 1.0, before[here - 1])
        now = (past[:, None] @ moved[here - 1])[:, 0]
        before[here] = now / now.sum(axis=1, keepdims=True)
    for here in reversed(np.split(order, cuts[:-1])[1:]):
        now = (moved[here] @ after[here][:, :, None])[:, :, 0]
        after[here - 1] = now / now.sum(axis=1, keepdims=True)
    return before, after


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, start: np.ndarray, trans: np.ndarray, lexicon: np.ndarray):
        self.labels, self.weights, self.start, self.trans, self.lexicon = labels, weights, start, trans, lexicon
        self.clear()

    def __reduce__(self):
        return Model, (self.labels, self.weights, self.start, self.trans, self.lexicon)

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.first = np.zeros(1, np.int64)  # of each token in place, its first word in known, and the end
        self.known = np.zeros((1 << 12, len(self.labels)), np.float32)
        self.count = 0

    def _learn(self, tokens: list[str]) -> None:
        words: list[str] = []
        ends = []
        for t in tokens:
            words += parts(t)
            ends.append(self.count + len(words))
            self.place[t] = len(self.place)
        self.first = np.concatenate([self.first, np.array(ends, np.int64)])
        while self.count + len(words) > len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            self.known[self.count : self.count + len(some)] = self.weights[features(some, self.lexicon)].sum(axis=1)
            self.count += len(some)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, share of the expected words) of each text; `und` and 0 without a letter."""
        if self.count > LIMIT or len(self.place) > 2 * LIMIT:
            self.clear()
        cut = [(t or "").split() for t in texts]
        met: set[str] = set()
        for tokens in cut:
            met.update(tokens)
        if new := [t for t in met if t not in self.place]:
            self._learn(new)
        get = self.place.__getitem__
        at = np.fromiter((x for tokens in cut for x in map(get, tokens)), np.int64)
        doc = np.repeat(np.arange(len(cut)), [len(x) for x in cut])
        first, many = self.first[at], self.first[at + 1] - self.first[at]
        at = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        doc = np.repeat(doc, many)
        size = np.bincount(doc, minlength=len(cut))
        chains = -(-size // CHAIN)
        k = len(self.labels)
        total = np.zeros((len(cut), k))
        if len(at):
            within = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            chain = np.repeat(np.cumsum(chains) - chains, size) + within // CHAIN
            of = np.repeat(np.arange(len(cut)), chains)
            length = np.bincount(chain, minlength=len(of))
            scores = np.zeros((len(of), min(CHAIN, int(size.max())), k), np.float32)
            scores[chain, within % CHAIN] = self.known[at]
            before, after = messages(scores, length, of, self.start, self.trans)
            for i in range(0, len(of), 4096):
                part = slice(i, i + 4096)
                gamma, _ = forward_backward(scores[part], length[part], self.start, self.trans, before=before[part], after=after[part])
                np.add.at(total, of[part], gamma.sum(axis=1))
        best = total.argmax(axis=1)
        return [(self.labels[b], float(min(1.0, total[i, b] / size[i]))) if size[i] else ("und", 0.0) for i, b in enumerate(best)]


def train(windows: list[tuple[str, list[str]]], steps: int = 40, rate: float = 0.5, seed: int = 6, least: int = 5) -> Model:
    """Fit on (language, words) windows, the words as parts() gives them, spliced at random into chains in which the language may change from window to window."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in windows})
    k = len(labels)
    index = {lang: i for i, lang in enumerate(labels)}
    vocabulary: dict[str, int] = {}
    seen: list[int] = []
    coded = []
    for lang, tokens in windows:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in tokens]
        seen += ids
        if ids:
            coded.append((index[lang], ids))
    words = list(vocabulary)
    often = np.bincount(np.array(seen, np.int64), minlength=len(words))
    lexicon = np.sort(word_hash([w for w, n in zip(words, often, strict=True) if n >= least]))
    f = features(words, lexicon) if words else np.zeros((0, 1), np.int32)
    chains, order = [], rng.permutation(len(coded))
    now: list[tuple[int, int]] = []
    for i in order:
        gold, ids = coded[i]
        now += [(w, gold) for w in ids]
        if rng.random() < 0.5 or len(now) >= CHAIN:
            chains.append(now[:CHAIN])
            now = []
    if now:
        chains.append(now[:CHAIN])
    d = 1 << BITS
    weights, start, trans = np.zeros((d + 1, k), np.float32), np.zeros(k), np.zeros((k, k))
    if not chains:
        return Model(labels or ["und"], np.zeros((d + 1, max(1, k)), np.float32), np.zeros(max(1, k)), np.zeros((max(1, k),) * 2), lexicon)
    length = np.array([len(c) for c in chains])
    word, gold = (np.zeros((len(chains), CHAIN), np.int64) for _ in range(2))
    for i, c in enumerate(chains):
        word[i, : len(c)], gold[i, : len(c)] = zip(*c, strict=True)
    valid = np.arange(CHAIN)[None, :] < length[:, None]
    truth = np.eye(k)[gold] * valid[:, :, None]
    moves = np.zeros((k, k))
    np.add.at(moves, (gold[:, :-1][valid[:, 1:]], gold[:, 1:][valid[:, 1:]]), 1)
    squares = np.full_like(weights, 1e-6), np.full(k, 1e-6), np.full((k, k), 1e-6)
    n = valid.sum()
    for _ in range(steps):
        known = weights[f].sum(axis=1)
        gamma, xi = forward_backward(known[word].astype(np.float64), length, start, trans, True)
        lack = (truth - gamma)[valid]
        by_word = np.stack([np.bincount(word[valid], lack[:, j], len(words)) for j in range(k)], axis=1)
        gradient = np.stack([np.bincount(f.ravel(), np.repeat(by_word[:, j], f.shape[1]), d + 1) for j in range(k)], axis=1)
        gradient[d] = 0
        for x, g, s in zip((weights, start, trans), (gradient / n - 1e-6 * weights, (truth[:, 0] - gamma[:, 0]).mean(axis=0), (moves - xi) / n), squares, strict=True):
            s += g * g
            x += (rate * g / np.sqrt(s)).astype(x.dtype) * (0.2 if x is weights else 0.5)
        weights[d] = 0
    return Model(labels, weights, start, trans, lexicon)


def sample(docs: DataFrame, text: str, lang: str, key: str, per_lang: int = DOCS_PER_LANG) -> list[tuple[str, list[str]]]:
    """Windows of words from at most per_lang training documents of each language, spread over their whole texts."""
    fold = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3))
    rows = docs.filter(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold != 1))
    rows = rows.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    # a share of the ids, by hash, that leaves about four times per_lang of them, is ranked: no task gets more, however many there are and however often rows repeat
    many = rows.groupBy(F.col("lang").alias("_l")).agg(F.approx_count_distinct("key", 0.02).alias("_many"))
    few = F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("_many") <= 4 * per_lang
    near = rows.select("key", "lang").join(keep(many, "languages"), F.col("lang") == F.col("_l")).filter(few)
    ids = near.select("key", "lang").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))).filter(F.col("r") <= per_lang)
    ids = keep(ids.select(F.col("key").alias("_k")).distinct(), "sampled")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key_, lang_, t in zip(b["key"], b["lang"], b["text"], strict=True):
                tokens = [w for token in t.split() for w in parts(token)]
                for i in range(WINDOWS):
                    at = max(0, len(tokens) - WINDOW_WORDS) * i // (WINDOWS - 1)
                    if i == 0 or len(tokens) > WINDOW_WORDS:
                        out.append((lang_, str(key_), i, " ".join(tokens[at : at + WINDOW_WORDS])))
            yield pd.DataFrame(out, columns=["lang", "key", "i", "words"])

    # rows that share an id give one set of windows for each language, so at most per_lang * WINDOWS for each language reach the driver
    picked = rows.join(F.broadcast(ids), F.col("key") == F.col("_k"), "left_semi").mapInPandas(run, "lang string, key string, i int, words string")
    one = picked.groupBy("lang", "key", "i").agg(F.min("words").alias("words"))
    return sorted((r.lang, r.words.split()) for r in one.collect())


@tidy
def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """key, held_out, lang_pred and score for every row.

    Training uses rows whose crc32(key) mod 3 is not 1, with text and language; prediction uses the text alone. `und` (score 0) stands
    for a null text or one without a letter, or if there is nothing to learn from. A null key is not held out and not learned from.
    Repeated rows are predicted alike and give one set of windows; very long texts are read whole; other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    windows = sample(docs, text, lang, key, per_lang)
    model = train(windows)
    kind = dict(docs.dtypes)[key]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS and the number of languages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            got = own.predict([t if isinstance(t, str) else None for t in b["_text"]])
            yield pd.DataFrame({"key": b["key"], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got]})

    with arrow_batches(docs.sparkSession, 512):
        rows = docs.select(F.col(key).alias("key"), F.col(text).alias("_text"))
        found = keep(rows.mapInPandas(run, f"key {kind}, lang_pred string, score double"), "languages")
    held = F.coalesce(F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return found.select(F.col("key").alias(key), held.alias("held_out"), "lang_pred", "score")
