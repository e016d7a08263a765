"""Words and word shingles of a slice of documents as 64-bit hashes, computed on the bytes of the whole slice at once."""

from __future__ import annotations

import numpy as np

from tessera.llm.common import bytes_of

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 256) - 1, _BASE, np.uint64))])
    return _powers


def words(column, lower: bool = True, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of bytes other than space and \\t..\\r: hashes, where each document's begin (documents + 1), first and end bytes."""
    data, off = bytes_of(column)
    n = len(data)
    space = space[data]
    first = np.empty(n, bool)
    if n:
        first[0] = True
        first[1:] = space[:-1]
        begins = off[:-1]
        first[begins[begins < n]] = True
    starts = np.flatnonzero(first & ~space)
    cut = np.searchsorted(starts, off)
    if not len(starts):
        return np.empty(0, np.uint64), cut, starts, starts
    lengths = np.diff(np.append(starts, n))
    inside = np.arange(starts[0], n) - np.repeat(starts, lengths)
    tail, gap = data[starts[0] :], space[starts[0] :]
    terms = (LOWER[tail] if lower else tail).astype(np.uint64) + np.uint64(1)
    terms *= powers(int(lengths.max()))[inside]
    terms[gap] = 0
    at = starts - starts[0]
    ends = starts + np.add.reduceat((~gap).astype(np.int64), at)
    return mix(np.add.reduceat(terms, at)), cut, starts, ends


def shingles(hashes: np.ndarray, cut: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each document's sorted distinct shingles of `size` words, as 62-bit ints; of a shorter document the whole as one; none without words."""
    n = len(hashes)
    whole = np.zeros(max(0, n - size + 1), np.uint64)
    for i in range(size):
        whole += hashes[i : i + len(whole)] * _STEPS[i % 5] * np.uint64(2 * (i // 5) + 1)
    whole = (mix(whole) >> np.uint64(2)).view(np.int64)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            short = hashes[a:b] * _STEPS[: b - a]
            out.append((mix(short.sum(keepdims=True) + np.uint64(b - a)) >> np.uint64(2)).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


class Known:
    """Rows of remembered hashes, 16 bytes each: two sorted arrays, the newer merged into the older now and then."""

    RECENT = 100_000

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.old = self.new = (np.empty(0, np.uint64), np.empty(0, np.int64))

    def __len__(self) -> int:
        return len(self.old[0]) + len(self.new[0])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The hashes' rows, -1 for those not remembered."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, rows in (self.old, self.new):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                out[hit] = rows[at[hit]]
        return out

    def add(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        """Hashes that are not remembered yet, ascending."""
        self.new = self._merged(self.new, (hashes, rows))
        if len(self.new[0]) > self.RECENT:
            self.old, self.new = self._merged(self.old, self.new), (np.empty(0, np.uint64), np.empty(0, np.int64))

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(a[0], b[0])  # both are sorted: no sort of the whole
        return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])
