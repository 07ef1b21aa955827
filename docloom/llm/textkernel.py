"""Vectorised text primitives shared by the training-data operators.

Every function works on a run of documents laid end to end in one byte buffer (the Arrow layout of a string
column), so the cost per document is a few numpy calls per megabyte and never a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for slot, base in enumerate((BASE, BASE_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[slot] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, target: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of documents of about ``target`` bytes; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words (maximal runs without ASCII white space) of some documents.

    ``start``/``end`` are byte positions in ``raw``, ``first[d]:first[d + 1]`` are the words of document d.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        gap = np.ones(n + 1, bool)
        gap[:n] = SPACE[raw]
        here = ~gap[:n]
        begin = here.copy()
        begin[1:] &= gap[: n - 1]
        last = here.copy()
        last[: n - 1] &= gap[1:n]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begin[inner] = here[inner]
        last[inner - 1] = here[inner - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def hashes(self, lower: bool = True, letters_only: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, of lower-cased ASCII letters if so wished; letters_only leaves out ASCII punctuation."""
        raw = LOWER[self.raw] if lower else self.raw
        if letters_only:
            drop = PUNCT[raw]
            value = raw.astype(np.uint64) + np.uint64(1)
            value[drop] = 0
            keep = np.concatenate([[0], np.cumsum(~drop)])
            rank = keep[:-1]
            p, q = powers(len(raw) + 1)
            h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * p[rank])])
            return mix((h[self.end] - h[self.start]) * q[keep[self.start]])
        return spans(prefix(raw), self.start, self.end)


PUNCT = np.zeros(256, bool)
PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def prefix(raw: np.ndarray) -> np.ndarray:
    p, _ = powers(len(raw) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)])])


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans start:end, equal for equal bytes wherever they stand."""
    _, q = powers(len(h))
    return mix((h[end] - h[start]) * q[start])


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and their bounds per document. A document of 1 to k-1 words has one, of all its words."""
    n = len(words)
    counts = np.diff(first)
    full = np.zeros(n, np.uint64)
    for i in range(k):
        if n - i > 0:
            full[: n - i] = full[: n - i] * STEP + words[i:]
        # tails mix in nothing and are cut off below
    keep = np.ones(n, bool)
    short = np.flatnonzero((counts > 0) & (counts < k))
    position = np.arange(n) - np.repeat(first[:-1], counts)
    left = np.repeat(counts, counts) - position
    keep &= left >= k
    for d in short:
        a, b = first[d], first[d + 1]
        h = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for w in words[a:b]:
                h = h * STEP + w
        full[a], keep[a] = h, True
    bounds = np.concatenate([[0], np.cumsum(keep)])[first]
    return mix(full[keep]), bounds


def reduce_min(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum per non-empty range of bounds; empty ranges must have been left out by the caller."""
    return np.minimum.reduceat(values, bounds)
