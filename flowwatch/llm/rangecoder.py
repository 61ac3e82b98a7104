"""Block format for token ids: an adaptive context-mixing range coder over many interleaved lanes.

A block holds whole documents and stands alone: models start anew in it and a CRC-32 closes it.  Its ids are cut into
lanes of equal length that are coded in step, one id of every lane at a time, so that each step is a few numpy
operations over all lanes.  All lanes share the block's models:

* order 2 and order 1: the id that last followed the two ids (the id) before, with a confidence;
* order 0: adaptive counts of all ids.

For each id the mixer turns the two confidences (and whether both name the same id) into adaptive weights of the three models,
and the mixed distribution drives a carry-less range coder with 64-bit state and 16-bit output words.
All arithmetic is on integers, so encoder and decoder agree exactly.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .textkit import U64, bounds

MAGIC = b"CMR1"
_HEAD = struct.Struct("<4sIIIII")          # magic, documents, ids, lanes, largest id, payload words
LANE_STEPS = 256
MAX_LANES = 4096
_TOP, _BOT = U64(1 << 48), U64((1 << 40) - 1)
_S16, _S32, _S48 = U64(16), U64(32), U64(48)
_WEIGHT_BITS, _COUNT_BITS, _SLOT_BITS = 12, 20, 18
_REFRESH = 16


class _Models:
    """Predictions and their updates; the same object drives both directions."""

    def __init__(self, top_id: int):
        self.size = top_id + 1
        #: id << 3 | confidence; order 1 by id, order 2 by a hash of two ids.
        self.order1 = np.zeros(self.size, np.int32)
        self.order2 = np.zeros(1 << _SLOT_BITS, np.int32)
        self.counts = np.ones(self.size, np.int64)
        self.hits = np.tile(np.array([2, 2, 4], np.int64), (128, 1))
        self.pending: list[np.ndarray] = []
        self.steps = 0
        self._refresh()

    def _refresh(self) -> None:
        if self.pending:
            self.counts += np.bincount(np.concatenate(self.pending), minlength=self.size)
            self.pending = []
        spare = (1 << _COUNT_BITS) - self.size
        freq = self.counts * spare // int(self.counts.sum()) + 1
        self.cum = bounds(freq).astype(np.uint32)
        total = self.hits.sum(1)
        room = (1 << _WEIGHT_BITS) - 32
        w2 = self.hits[:, 0] * room // total
        w1 = self.hits[:, 1] * room // total
        w1[1::2] = 0                       # both name the same id: order 1 has no weight of its own
        w0 = (1 << _WEIGHT_BITS) - w2 - w1
        self.weights = (w2 << 32 | w1 << 16 | w0).astype(np.uint64)
        big = total > 1 << 16
        self.hits[big] = self.hits[big] // 2 + 1

    def predict(self, before: np.ndarray, last: np.ndarray):
        self.slot = ((last.astype(np.uint32) * np.uint32(0x9E3779B1) ^ before.astype(np.uint32) * np.uint32(0x85EBCA6B))
                     >> np.uint32(32 - _SLOT_BITS))
        self.last = last
        self.e2, self.e1 = self.order2[self.slot], self.order1[last]
        self.p2, self.p1 = self.e2 >> 3, self.e1 >> 3
        self.mix = (self.e2 & 7) << 4 | (self.e1 & 7) << 1 | (self.p2 == self.p1)
        w = self.weights[self.mix]
        return self.p2, self.p1, w >> _S32, w >> _S16 & U64(0xFFFF), w & U64(0xFFFF)

    def learn(self, ids: np.ndarray, kind: np.ndarray) -> None:
        self.hits += np.bincount(self.mix * 3 + kind, minlength=384).reshape(128, 3)
        fresh = ids << 3
        for table, at, old, guess in ((self.order2, self.slot, self.e2, self.p2), (self.order1, self.last, self.e1, self.p1)):
            sure = old & 7
            missed = np.where(sure > 1, old - sure + (sure >> 1), fresh | sure >> 1)
            table[at] = np.where(guess == ids, np.minimum(old + 1, old | 7), missed)
        self.pending.append(ids)
        self.steps += 1
        if self.steps % _REFRESH == 0 or self.steps < _REFRESH:
            self._refresh()


def _lanes(n: int) -> int:
    return max(1, min(MAX_LANES, n // LANE_STEPS))


def _settle(low: np.ndarray, span: np.ndarray, shifted) -> None:
    """Renormalise: ``shifted(lanes)`` is called for lanes whose next 16 bits are fixed."""
    while True:
        settled = (low ^ (low + span)) < _TOP
        tight = ~settled & (span <= _BOT)
        need = np.flatnonzero(settled | tight)
        if len(need) == 0:
            return
        squeeze = np.flatnonzero(tight)
        span[squeeze] = (~low[squeeze] + U64(1)) & _BOT
        shifted(need)
        low[need] <<= _S16
        span[need] <<= _S16


def encode_block(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One block: bigint document ids, ids per document, and all ids one after another."""
    n = len(ids)
    ids = ids.astype(np.int32)
    lanes = _lanes(n)
    top = int(ids.max()) if n else 0
    steps = -(-n // lanes)
    body, counts = b"", np.zeros(lanes, np.uint32)
    if n:
        grid = np.zeros(lanes * steps, np.int32)
        grid[:n] = ids
        grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
        models = _Models(top)
        low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        out_lane, out_word = [], []

        def emit(need):
            out_lane.append(need)
            out_word.append((low[need] >> _S48).astype(np.uint16))

        last = before = np.zeros(lanes, np.int32)
        for t in range(steps):
            x = grid[t]
            p2, p1, w2, w1, w0 = models.predict(before, last)
            hit2 = x == p2
            hit1 = (x == p1) & ~hit2
            begin, end = models.cum[x].astype(np.uint64), models.cum[x + 1].astype(np.uint64)
            base = (w2 + w1) << U64(_COUNT_BITS)
            cum = np.where(hit2, U64(0), np.where(hit1, w2 << U64(_COUNT_BITS), base + w0 * begin))
            freq = np.where(hit2, w2 << U64(_COUNT_BITS), np.where(hit1, w1 << U64(_COUNT_BITS), w0 * (end - begin)))
            none = freq == 0                            # a weight may be zero: such an id goes by its count
            if none.any():
                cum, freq = np.where(none, base + w0 * begin, cum), np.where(none, w0 * (end - begin), freq)
            kind = np.int32(2) - (hit2 << np.int32(1)) - hit1
            unit = span >> _S32
            low += unit * cum
            span = unit * freq
            _settle(low, span, emit)
            models.learn(x, kind)
            before, last = last, x
        for _ in range(4):
            emit(np.arange(lanes))
            low <<= _S16
        lane = np.concatenate(out_lane)
        order = np.argsort(lane, kind="stable")
        body = np.concatenate(out_word)[order].astype("<u2").tobytes()
        counts = np.bincount(lane, minlength=lanes).astype(np.uint32)
    raw = b"".join((_HEAD.pack(MAGIC, len(sizes), n, lanes, top, len(body) // 2), doc_ids.astype("<i8").tobytes(),
                    sizes.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), body))
    return raw + struct.pack("<I", zlib.crc32(raw))


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids); a damaged block is an error."""
    raw, (check,) = block[:-4], struct.unpack("<I", block[-4:])
    if zlib.crc32(raw) != check:
        raise ValueError("block checksum does not match")
    magic, docs, n, lanes, top, words = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size
    doc_ids = np.frombuffer(raw, "<i8", docs, at).astype(np.int64)
    sizes = np.frombuffer(raw, "<u4", docs, at + 8 * docs).astype(np.int64)
    counts = np.frombuffer(raw, "<u4", lanes, at + 12 * docs).astype(np.int64)
    if n == 0:
        return doc_ids, sizes, np.zeros(0, np.uint32)
    stream = np.frombuffer(raw, "<u2", words, at + 12 * docs + 4 * lanes).astype(np.uint64)
    ptr = np.cumsum(counts) - counts
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = code << _S16 | stream[ptr]
        ptr += 1
    stream = np.concatenate((stream, np.zeros(1, np.uint64)))
    steps = -(-n // lanes)
    grid = np.empty((steps, lanes), np.int32)
    models = _Models(top)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)

    def pull(need):
        code[need] = code[need] << _S16 | stream[ptr[need]]
        ptr[need] += 1

    last = before = np.zeros(lanes, np.int32)
    shift = U64(_COUNT_BITS)
    for t in range(steps):
        p2, p1, w2, w1, w0 = models.predict(before, last)
        unit = span >> _S32
        v = np.minimum((code - low) // unit, U64((1 << 32) - 1))
        whole = v >> shift
        hit2 = whole < w2
        hit1 = ~hit2 & (whole < w2 + w1)
        base = (w2 + w1) << shift
        rest = np.flatnonzero(~(hit2 | hit1))
        x = np.where(hit2, p2, p1)
        cum = np.where(hit2, U64(0), w2 << shift)
        freq = np.where(hit2, w2, w1) << shift
        w0, base = w0[rest], base[rest]
        x[rest] = found = np.searchsorted(models.cum, ((v[rest] - base) // w0).astype(np.uint32), "right") - 1
        begin, end = models.cum[found].astype(np.uint64), models.cum[found + 1].astype(np.uint64)
        cum[rest] = base + w0 * begin
        freq[rest] = w0 * (end - begin)
        # an id named by a model of weight zero was coded by its count, yet counts as that model's hit
        hit2 = x == p2
        kind = np.int32(2) - (hit2 << np.int32(1)) - ((x == p1) & ~hit2)
        low += unit * cum
        span = unit * freq
        _settle(low, span, pull)
        grid[t] = x
        models.learn(x, kind)
        before, last = last, x
    return doc_ids, sizes, np.ascontiguousarray(grid.T).reshape(-1)[:n].astype(np.uint32)
