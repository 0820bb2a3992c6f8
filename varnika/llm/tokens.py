"""Token ids of many texts with a tokenizer file: each distinct blank-separated chunk of a batch is tokenized once.

The tokenizer splits at white space before anything else, so the ids of a text are those of its chunks in order. Arrow cuts the texts into
chunks and finds the distinct ones. This is for byte-level pair merging models that lower-case first and take runs of letters as words: runs of
letters of the Latin-1 range that begin a chunk are merged together as arrays, a step of all words at a time, in
the order of the file's merge list; the library tokenizes all else. No state grows with the texts but a bounded cache of that.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts whose ids the library gave are kept, up to so many.
LIMIT = 50_000
#: Tokens that are put together, and words that are merged, at once; the longest word (in bytes) that is.
AT_ONCE, WORDS, LONGEST = 200_000, 1 << 15, 62
#: Byte-level models write each byte as one character: printable ones as they are, the others from U+0100 on.
_kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_kept)))} | {b: chr(b) for b in _kept}
NONE = 1 << 30
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True
_made: dict[str, Tokens] = {}


class Merges:
    """The merge list of a model as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.byte = np.array([vocab[BYTES[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[BYTES[b] + self.end] for b in range(256)], np.int64)
        self.many = max(vocab.values()) + 2
        self.pad = self.many - 1
        keys = np.array([vocab[a] * self.many + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # a table of two places for each key (cuckoo hashing), so that a look-up is two reads
        self.bits = int(len(keys)).bit_length() + 1
        self.keys, self.ranks = np.full(2 << self.bits, -1, np.int64), np.full(2 << self.bits, NONE, np.int32)
        h1, h2 = (x.tolist() for x in self._places(keys))
        for k, key in enumerate(keys.tolist()):
            rank, at = k, h1[k]
            for _ in range(500):
                key, self.keys[at] = int(self.keys[at]), key
                rank, self.ranks[at] = int(self.ranks[at]), rank
                if key < 0:
                    break
                at = h2[rank] if at == h1[rank] else h1[rank]
            else:
                raise ValueError("the merge list doesn't fit the table")

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, shift = keys.astype(np.uint64), np.uint64(64 - self.bits)
        one, two = (x * np.uint64(0x9E3779B97F4A7C15)) >> shift, (x * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift
        return one.astype(np.int64), two.astype(np.int64) + (1 << self.bits)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair in the merge list, NONE if it isn't there."""
        keys = a * self.many + b
        one, two = self._places(keys)
        return np.where(self.keys[one] == keys, self.ranks[one], np.where(self.keys[two] == keys, self.ranks[two], NONE))

    def merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of the words of data that begin at start, of like sizes: at each step every word merges its first pair of lowest rank."""
        n, width = len(start), int(size.max()) + 2
        column = np.arange(width)
        inside = (column >= 1) & (column <= size[:, None])
        symbol = np.full((n, width), self.pad, np.int64)
        symbol[inside] = self.byte[data[(start[:, None] + column - 1)[inside]]]
        symbol[np.arange(n), size] = self.last[data[start + size - 1]]
        out, flat = symbol, symbol.ravel()
        rank = np.full((n, width), NONE, np.int32)
        both = inside[:, :-1] & inside[:, 1:]
        rank[:, :-1][both] = self.rank(symbol[:, :-1][both], symbol[:, 1:][both])
        after = np.broadcast_to(column + 1, (n, width)).copy().ravel()
        before = np.broadcast_to(column - 1, (n, width)).copy().ravel()
        rows = np.arange(n)  # those of rank, after and before, in the output
        while len(rows):
            at = rank.argmin(axis=1)
            base = np.arange(len(rows)) * width
            best = rank.ravel()[base + at]
            open_ = best < NONE
            if np.count_nonzero(open_) < 0.8 * len(rows):
                rank, rows = rank[open_], rows[open_]
                after, before = (x.reshape(-1, width)[open_].ravel() for x in (after, before))
                continue
            if not open_.all():
                at, base, best, own = at[open_], base[open_], best[open_], rows[open_] * width
            else:
                own = rows * width
            new = self.made[best]
            gone = after[base + at]
            then, left = after[base + gone], before[base + at]
            flat[own + at], flat[own + gone] = new, -1
            after[base + at], before[base + then] = then, at
            got = self.rank(np.concatenate([flat[own + left], new]), np.concatenate([new, flat[own + then]]))
            r = rank.ravel()
            r[base + gone] = NONE
            r[base + left], r[base + at] = got[: len(at)], got[len(at) :]
        stays = (out >= 0) & (out != self.pad)
        return out[stays].astype(np.uint32), stays.sum(axis=1)


class Tokens:
    def __init__(self, path: str, limit: int = LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.merges = Tokenizer.from_file(path), limit, Merges(path)
        alone = [self.tokenizer.encode(chr(b), add_special_tokens=False).ids for b in range(128)]
        self.mark = np.array([ids[0] if len(ids) == 1 and not chr(b).isspace() else -1 for b, ids in enumerate(alone)] + [-1] * 128)
        self.known: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> Tokens:
        """The worker's own, kept between tasks."""
        if path not in _made:
            _made[path] = cls(path)
        return _made[path]

    def _others(self, chunks: list[str]) -> list[list[int]]:
        if len(self.known) > self.limit:
            self.known = {}
        new = [c for c in chunks if c not in self.known]
        self.known.update(zip(new, (e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return [self.known[c] for c in chunks]

    def chunks(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, ids): where in ids those of each chunk stand."""
        n = len(distinct)
        ends = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + n + 1]
        raw = distinct.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and n else np.zeros(0, np.uint8)
        first, size = ends[:-1] - ends[0], np.diff(ends)
        # letters of Latin-1 beyond ASCII are C3 and a byte from 80 to BF, but for the signs of multiplication and division
        wide = data == 0xC3
        second = np.zeros(len(data), bool)
        second[1:] = wide[:-1] & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        fine = _letter[data] | second
        fine[:-1] |= wide[:-1] & second[1:]
        low = data + 32 * ((data >= 65) & (data <= 90) | second & (data <= 0x9E)).astype(np.uint8)
        # a chunk is a run of letters and a rest, which tokenize apart unless the rest begins with a mark that joins the last letter
        breaks = np.append(np.flatnonzero(~fine), len(data))
        core = np.minimum(breaks[np.searchsorted(breaks, first)] - first, size)
        over = size > core
        plain = (core > 0) & (core <= LONGEST)
        plain[over] &= data[first[over] + core[over]] < 0x80
        single = plain & (size == core + 1)
        single[single] = self.mark[data[first[single] + core[single]]] >= 0
        rest = np.flatnonzero((over | ~plain) & ~single)
        at = np.where(plain, core, 0)[rest]
        texts = distinct.take(pa.array(rest)).to_pylist()
        cut = np.flatnonzero(at)
        for k, n_bytes in zip(cut.tolist(), at[cut].tolist(), strict=True):
            t = texts[k]
            texts[k] = t[n_bytes:] if t.isascii() else t.encode()[n_bytes:].decode()
        got = self._others(texts)
        more = np.zeros(n, np.int64)
        more[rest] = np.fromiter(map(len, got), np.int64, len(got))
        tail = np.fromiter((i for ids in got for i in ids), np.uint32, int(more.sum()))
        tail = np.concatenate([np.maximum(self.mark, 0).astype(np.uint32), tail])
        tail_at = len(self.mark) + np.cumsum(more) - more
        more[single], tail_at[single] = 1, data[first[single] + core[single]]
        start, count = np.zeros(n, np.int64), more.copy()
        found, used = [], 0

        def laid(which: np.ndarray, ids: np.ndarray, k: np.ndarray) -> None:
            """Appends, for each of these chunks, its k ids of the letters and those of its rest."""
            nonlocal used
            m = more[which]
            count[which] = k + m
            off = np.cumsum(k + m) - k - m
            out = np.empty(int((k + m).sum()), np.uint32)
            out[np.repeat(off - np.cumsum(k) + k, k) + np.arange(len(ids))] = ids
            if some := int(m.sum()):
                j = np.arange(some) - np.repeat(np.cumsum(m) - m, m)
                out[np.repeat(off + k, m) + j] = tail[np.repeat(tail_at[which], m) + j]
            start[which] = used + off
            found.append(out)
            used += len(out)

        order = np.flatnonzero(plain)
        order = order[np.argsort(core[order], kind="stable")]
        for i in range(0, len(order), WORDS):
            some = order[i : i + WORDS]
            laid(some, *self.merges.merged(low, first[some], core[some]))
        whole = np.flatnonzero(~plain)
        laid(whole, np.zeros(0, np.uint32), np.zeros(len(whole), np.int64))
        return start, count, np.concatenate(found)

    def encode(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, one after the other; null counts as empty."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        ends, which = np.diff(cut.offsets.to_numpy()).cumsum(), coded.indices.to_numpy()
        del cut
        start, size, flat = self.chunks(coded.dictionary)
        first, at = 0, 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, at + AT_ONCE, "right")))
            here = which[at : ends[last - 1]]
            n = size[here]
            upto = np.cumsum(n)
            ids = flat[np.repeat(start[here] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
            for k in range(first, last):
                lo, hi = (ends[k - 1] if k else 0) - at, ends[k] - at
                yield ids[upto[lo - 1] if lo else 0 : upto[hi - 1] if hi else 0]
            first, at = last, ends[last - 1]
