"""Averaged hashed subword embeddings with a softmax output, trained by stochastic gradient descent in numpy.

A text's features are the hashes of its byte n-grams and of its words (and of repeats of the word before); each has a vector, a text is
the mean of its features' vectors, and a linear softmax maps the mean to classes. Since that output is linear in the mean, a
trained model is folded into one row of class scores per bucket, and scoring is a hash, a lookup and a mean per text,
over whole texts, in vectorized passes over the bytes of many texts. A text longer than ``PART`` is read in blocks that see the
bytes after them and carry words over their ends, so its features are those of the whole text in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Zero bytes between texts; n-grams at a text's end run into them, never into the next text.
_PAD = b"\0" * 8
#: Longer texts are read in blocks of at most this many bytes.
PART = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(1099511628211)
_INVERSE = np.uint64(pow(1099511628211, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _TABLES or len(_TABLES[name]) < n:
        _TABLES[name] = _powers(base, max(n, PART + 4096))
    return _TABLES[name][:n]


class Features:
    """Bucket numbers of texts' features."""

    def __init__(self, bits: int = 18, orders: tuple = (2, 3, 4), lower: bool = False):
        self.bits, self.orders, self.lower = bits, orders, lower

    def __call__(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all features and the number of the part that each belongs to."""
        raw = b"".join([_PAD, *(x for part in parts for x in ((part.lower() if self.lower else part), _PAD))])
        lengths = np.array([len(x) for x in parts], np.int64)
        starts = len(_PAD) + np.concatenate(([0], np.cumsum(lengths + len(_PAD))[:-1])) if len(parts) else np.zeros(0, np.int64)
        owner = np.full(len(raw), -1, np.int32)
        for k, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
            owner[s : s + n] = k
        inside = np.flatnonzero(owner >= 0)
        data = np.frombuffer(raw, np.uint8)
        wide = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))[inside]
        shift = np.uint64(64 - self.bits)
        found, owners, inside_owner = [], [], owner[inside]
        for n in self.orders:
            gram = wide & np.uint64((1 << (8 * n)) - 1)
            found.append((((gram + np.uint64(n)) * _MIX) >> shift).astype(np.int32))
            owners.append(inside_owner)
        words, word_owner = self._words(data, owner)
        found.append(((words * _MIX) >> shift).astype(np.int32))
        owners.append(word_owner)
        again = np.flatnonzero((words[1:] == words[:-1]) & (word_owner[1:] == word_owner[:-1])) + 1 if len(words) else np.zeros(0, np.int64)
        found.append(np.full(len(again), (1 << self.bits) - 1, np.int32))
        owners.append(word_owner[again])
        return np.concatenate(found), np.concatenate(owners)

    def blocks(self, raw: bytes) -> Iterator[np.ndarray]:
        """Buckets of all features of one text of any length, some at a time."""
        raw = raw.lower() if self.lower else raw
        end, padded, shift = len(raw), np.frombuffer(raw + _PAD, np.uint8), np.uint64(64 - self.bits)
        for a in range(0, end, PART):
            wide = np.ndarray((min(end, a + PART) - a,), "<u8", padded, offset=a, strides=(1,))
            for n in self.orders:
                gram = wide & np.uint64((1 << (8 * n)) - 1)
                yield (((gram + np.uint64(n)) * _MIX) >> shift).astype(np.int32)
        last = None
        for words in self._word_blocks(padded[:end]):
            yield ((words * _MIX) >> shift).astype(np.int32)
            before = words[:-1] if last is None else np.concatenate(([last], words[:-1]))
            again = int((words[len(words) - len(before) :] == before).sum())
            yield np.full(again, (1 << self.bits) - 1, np.int32)
            last = words[-1]

    def _word_blocks(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """The hashes of the words of a text, in order; blocks end at blanks, and a word longer than a block is summed over blocks."""
        at, end = 0, len(data)
        while at < end:
            stop = min(end, at + PART)
            if stop < end and (blanks := np.flatnonzero(data[at:stop] <= 32)).size:
                stop = at + int(blanks[-1]) + 1
            elif stop < end:
                total, length, scale = np.zeros(1, np.uint64), 0, np.ones(1, np.uint64)
                while at < end and data[at] > 32:
                    some = data[at : at + PART]
                    blank = np.flatnonzero(some <= 32)
                    some = some[: blank[0]] if blank.size else some
                    total += (some * _table("up", _BASE, len(some))).sum(dtype=np.uint64) * scale
                    scale *= _table("up", _BASE, PART + 1)[len(some)]
                    length, at = length + len(some), at + len(some)
                yield total ^ np.uint64(length)
                continue
            words, _ = self._words(data[at:stop], np.zeros(stop - at, np.int32))
            if len(words):
                yield words
            at = stop

    @staticmethod
    def _words(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        solid = (data > 32).astype(np.int8)
        edge = np.diff(solid, prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # a word's hash is the sum of byte * base^position, brought back to position 0
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * _table("up", _BASE, len(data)), dtype=np.uint64)))
        return ((total[end] - total[begin]) * _table("down", _INVERSE, len(data))[begin]) ^ (end - begin).astype(np.uint64), owner[begin]


def _batches(raws: Iterable[tuple[int, bytes]], most: int = PART) -> Iterator[tuple[list[bytes], list[int]]]:
    """Texts and their numbers, some ``most`` bytes at a time."""
    texts, owners, size = [], [], 0
    for k, raw in raws:
        if size + len(raw) > most and texts:
            yield texts, owners
            texts, owners, size = [], [], 0
        texts.append(raw)
        owners.append(k)
        size += len(raw)
    if texts:
        yield texts, owners


class Scorer:
    """A trained model folded into class scores by bucket."""

    def __init__(self, features: Features, table: np.ndarray, bias: np.ndarray):
        self.features, self.table, self.bias = features, np.ascontiguousarray(table.T, np.float32), bias

    def logits(self, texts: list[str]) -> np.ndarray:
        sums, counts = np.zeros((len(texts), len(self.bias))), np.zeros(len(texts))

        def short() -> Iterator[tuple[int, bytes]]:
            for k, text in enumerate(texts):
                raw = text.encode("utf-8", "replace")
                if len(raw) <= PART:
                    yield k, raw
                    continue
                for buckets in self.features.blocks(raw):
                    sums[k] += [row[buckets].sum(dtype=np.float64) for row in self.table]
                    counts[k] += len(buckets)

        for raws, owners in _batches(short()):
            buckets, part = self.features(raws)
            for c in range(len(self.bias)):
                sums[owners, c] = np.bincount(part, self.table[c][buckets], len(raws))
            counts[owners] = np.bincount(part, minlength=len(raws))
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def probabilities(self, texts: list[str], temperature: float = 1.0) -> np.ndarray:
        z = self.logits(texts) / temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(texts: list[str], labels: np.ndarray, classes: int, features: Features, dims: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 3) -> Scorer:
    """Adaptive stochastic gradient descent on the cross-entropy, one text at a time."""
    rng = np.random.default_rng(seed)
    rows = []
    for text in texts:
        counts = np.zeros(1 << features.bits, np.int32)
        for buckets in features.blocks(text.encode("utf-8", "replace")):
            counts += np.bincount(buckets, minlength=1 << features.bits).astype(np.int32)
        ids = np.flatnonzero(counts)
        rows.append((ids, (counts[ids] / max(1, counts.sum())).astype(np.float32)))
    vectors = rng.uniform(-0.5, 0.5, (1 << features.bits, dims)).astype(np.float32)
    seen = np.full(1 << features.bits, 1e-6, np.float32)
    out = np.zeros((classes, dims), np.float32)
    bias = np.zeros(classes, np.float32)
    if len(labels):
        bias = np.log((np.bincount(labels, minlength=classes) + 0.5) / (len(labels) + 0.5 * classes)).astype(np.float32)
    out_seen = np.full((classes, dims), 1e-6, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(rows)):
            ids, share = rows[k]
            mean = share @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = p @ out
            gradient = np.outer(p, mean)
            out_seen += gradient * gradient
            out -= step * gradient / np.sqrt(out_seen)
            bias -= 0.01 * step * p
            seen[ids] += (share * share) * (back @ back / dims)
            vectors[ids] -= (step * share / np.sqrt(seen[ids]))[:, None] * back
    return Scorer(features, vectors @ out.T, bias)
