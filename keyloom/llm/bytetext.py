"""Whole Arrow string columns as numpy arrays: words, fingerprints and per-document sets.

A column is handled in slices of whole documents of about ``SLICE`` bytes, so that the
temporary arrays stay small; a single longer document is a slice of its own. Null is empty.
Words are the runs of ``[^\\x20\\x09-\\x0D]``; no multi-byte UTF-8 sequence holds such a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U = np.uint64
_BASE = U(0x9E3779B97F4A7C13)  # 3 modulo 8
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants of splitmix64)."""
    x = x.copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_RANDOM_LOWER = _RANDOM.copy()
_RANDOM_LOWER[65:91] = _RANDOM[97:123]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE + 1)
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        for k, b in enumerate((_BASE, inverse)):
            steps = np.full(size, b, np.uint64)
            steps[0] = U(1)
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


class Slice:
    """Some documents of a column: ``data`` (bytes), ``offsets`` (of documents), words."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n_docs = len(offsets) - 1
        n = len(data)
        word = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | edge[1:n]
        end = word.copy()
        end[:-1] &= ~word[1:] | edge[1:n]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        #: the words of document i are those from word_offsets[i] to word_offsets[i + 1]
        self.word_offsets = np.searchsorted(self.starts, offsets)

    def word_hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word, with A-Z as a-z if ``lower``."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        power, inverse = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_RANDOM_LOWER if lower else _RANDOM)[self.data] * power[:-1], dtype=np.uint64, out=total[1:])
        h = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))

    def words(self, at: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[Slice]:
    """The documents of ``column`` in order."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    first = 0
    for chunk in chunks:
        chunk = chunk.cast(pa.large_utf8()).fill_null("")
        n = len(chunk)
        if not n:
            continue
        _, offsets, data = chunk.buffers()
        offsets = np.frombuffer(offsets, np.int64, n + 1, chunk.offset * 8)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
            yield Slice(first + a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            a = b
        first += n


def shingles(part: Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the ``width``-word shingles of each document, repeats included.

    A document with fewer words, but at least one, has its whole sequence as its only
    shingle, which equals no shingle of another length. Case of A-Z is ignored.
    """
    w = part.word_hashes(lower=True)
    starts, counts = part.word_offsets[:-1], np.diff(part.word_offsets)
    n_sh = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(n_sh)])
    first = np.repeat(starts - offsets[:-1], n_sh) + np.arange(offsets[-1])  # of each shingle, its first word
    left = np.repeat(counts, n_sh)
    h = np.zeros(len(first), np.uint64)
    last = len(w) - 1
    for k in range(width):
        step = mix(h * U(0x9FB21C651E98DF25) + w[np.minimum(first + k, last)]) if len(first) else h
        h = np.where(k < left, step, h)
    return mix(h + np.minimum(left, width).astype(np.uint64) * U(0xA0761D6478BD642F)), offsets


def sets_of(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values in ascending order, and their offsets."""
    values = values.copy()
    bounds = offsets.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], total[offsets]
