"""Vectorised byte-level text helpers for Arrow batches: word spans and 64-bit substring hashes.

Everything works on the UTF-8 bytes of a slice of documents at once; slices are
bounded in bytes, so memory follows the slice (or one very long text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_CODES, _OTHER_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * U64(2) + U64(1)
_FOLDED = _CODES.copy()
_FOLDED[ord("A"):ord("Z") + 1] = _CODES[ord("a"):ord("z") + 1]
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: Bytes of a span above which ``SpanHasher`` hashes it as a whole.
LONG = 64


def _power_table(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, 1 << 16), _BASE if kind == "up" else _BASE_INV, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.multiply.accumulate(step)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _codes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A number per byte, or per code point of a uint32 buffer; ASCII has the same ones in both."""
    if data.dtype == np.uint8:
        return table[data]
    out = table[np.minimum(data, 127)]
    wide = data > 127
    out[wide] = mix64(data[wide].astype(np.uint64) * table[128]) | U64(1)
    return out


def code_points(data: np.ndarray, *spans: np.ndarray) -> list[np.ndarray]:
    """The code points of UTF-8 bytes, and the byte positions ``spans`` among them; bytes that are no UTF-8 stand for themselves."""
    lead = (data & 0xC0) != 0x80
    if lead.all():
        return [data, *spans]
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return [data, *spans]
    before = np.concatenate(([0], np.cumsum(lead)))
    return [points, *(before[s] for s in spans)]


def _prefix(codes: np.ndarray) -> np.ndarray:
    codes *= _power_table("up", len(codes))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes, out=out[1:])
    return out


def _between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((prefix[end] - prefix[start]) * _power_table("down", len(prefix))[start])


class SpanHasher:
    """Hashes of spans of one buffer of bytes (``rolling`` also of code points).

    ``rolling`` is a prefix polynomial, constant time per span.  Modulo 2^64 a polynomial maps some long regular
    strings (a Thue-Morse word and its complement, from about 1,000 bytes on) to one value whatever its base, so it only
    serves where candidates are verified.  Calls, whose values stand for the bytes themselves, hash spans above ``LONG`` as a whole.
    """

    def __init__(self, data: np.ndarray, fold_case: bool = False):
        self.data, self.fold_case = data, fold_case
        codes = _codes(data, _FOLDED if fold_case else _CODES)
        self.prefix = _prefix(codes)

    def rolling(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _between(self.prefix, start, end)

    def rolling_without(self, start: np.ndarray, end: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """``rolling`` of the spans with the character at ``gap`` left out."""
        head = self.prefix[gap] - self.prefix[start]
        tail = (self.prefix[end] - self.prefix[gap + 1]) * U64(_BASE_INV)
        return mix64((head + tail) * _power_table("down", len(self.prefix))[start])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = self.rolling(start, end)
        far, whole = self._whole(start, end)
        found[far] = whole[:, 0]
        return found

    def pairs(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every span and a second one that does not depend on it: 128 bits."""
        first, second = self.rolling(start, end), _between(_prefix(_codes(self._folded(), _OTHER_CODES)), start, end)
        far, whole = self._whole(start, end)
        first[far], second[far] = whole[:, 0], whole[:, 1]
        return first, second

    def _folded(self) -> np.ndarray:
        return _LOWER[self.data] if self.fold_case else self.data

    def _whole(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The spans above LONG, and 128 bits of each."""
        far = np.flatnonzero(end - start > LONG)
        if len(far) == 0:
            return far, np.zeros((0, 2), np.uint64)
        raw = memoryview(np.ascontiguousarray(self._folded()))
        digests = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start[far].tolist(), end[far].tolist())]
        return far, np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive slices of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offs_buf, data_buf = column.buffers()
    offs = np.frombuffer(offs_buf, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word ``[^\\x20\\x09-\\x0D]+``; no word crosses a document border."""
    if len(data) == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    border = np.zeros(len(data) + 1, bool)
    border[offs] = True
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | border[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | border[1:-1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def counts_per_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n)[:n]


def bounds(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def shingle_hashes(word_hash: np.ndarray, doc_bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its word shingles; a shorter text is one shingle, no words none."""
    n = len(word_hash)
    out = []
    rolled = None
    if n >= width:
        rolled = word_hash[:n - width + 1].copy()
        for k in range(1, width):
            rolled *= U64(0xD6E8FEB86659FD93)
            rolled ^= rolled >> U64(32)
            rolled += word_hash[k:n - width + 1 + k]
        rolled = mix64(rolled)
    for a, b in zip(doc_bounds[:-1], doc_bounds[1:]):
        if b - a >= width:
            h = np.sort(rolled[a:b - width + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif b > a:
            acc = U64(b - a)
            with np.errstate(over="ignore"):
                for w in word_hash[a:b]:
                    acc = acc * U64(0xA24BAED4963EE407) + w
            out.append(mix64(np.array([acc], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
