"""Per-word values computed once per distinct word: a direct-mapped table over 64-bit word hashes.

The table has a fixed number of slots, so a worker's memory does not follow the vocabulary; a word that
finds its slot held by another is computed again and takes the slot.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textkit import U64


def first_of_each(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct key, position of every key among them)."""
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return first, inverse


def gather_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, with their bounds."""
    size = end - start
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
    return data[at], np.concatenate(([0], ends))


class WordValues:
    """``compute(bytes, bounds) -> float32 (words, k)`` behind the table."""

    def __init__(self, compute: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, bits: int = 19):
        self.compute, self.shift = compute, U64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros((1 << bits, width), np.float32)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> self.shift).astype(np.int64)
        out = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != hashes)
        if len(missed):
            first, inverse = first_of_each(hashes[missed])
            one = missed[first]
            fresh = self.compute(*gather_spans(data, start[one], end[one])).astype(np.float32)
            out[missed] = fresh[inverse]
            self.keys[slot[one]] = hashes[one]
            self.values[slot[one]] = fresh
        return out


class WordIds:
    """``encode(list of str) -> list of id lists`` behind the table; ids lie in one pool that starts anew when full."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], bits: int = 19, pool: int = 1 << 22):
        self.encode, self.bits, self.pool_size = encode, bits, pool
        self._reset()

    def _reset(self) -> None:
        self.shift = U64(64 - self.bits)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.begin = np.zeros(1 << self.bits, np.int64)
        self.size = np.zeros(1 << self.bits, np.int64)
        self.pool, self.used = np.zeros(self.pool_size, np.uint32), 0

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        slot = (hashes >> self.shift).astype(np.int64)
        begin, size = self.begin[slot], self.size[slot]
        missed = np.flatnonzero(self.keys[slot] != hashes)
        source = self.pool
        if len(missed):
            first, inverse = first_of_each(hashes[missed])
            one = missed[first]
            raw = data.tobytes()
            ids = self.encode([raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            extra = np.fromiter((i for word in ids for i in word), np.uint32, int(sizes.sum()))
            begins = np.cumsum(sizes) - sizes + self.used
            begin[missed], size[missed] = begins[inverse], sizes[inverse]
            room = self.used + len(extra) <= self.pool_size
            if room:
                self.pool[self.used:self.used + len(extra)] = extra
                self.used += len(extra)
                self.keys[slot[one]], self.begin[slot[one]], self.size[slot[one]] = hashes[one], begins, sizes
            else:
                source = np.concatenate((self.pool[:self.used], extra))
                self._reset()
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)
        return source[at], size
