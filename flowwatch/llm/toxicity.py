"""Operator 9: toxicity by a gapped-subsequence string-kernel support vector machine with Nyström landmarks.

Strings are words without punctuation, folded to lower case, between ``<`` and ``>``; runs of single letters read as one
word.  The kernel counts common subsequences of three characters (bytes) with up to two skipped characters
after each, every skip weighing ``decay``, divided by both strings' weights; so ``idxiot`` stays close to ``idiot``.  Nyström: a string is
mapped to its kernels with landmark words times K^-1/2; a squared-hinge machine is trained on these.

Labels mark documents, so the machine learns which strings make a document toxic: each toxic document's best
string and strings that hardly occur elsewhere are positives, strings of other documents are negatives, the hardest mined
each round.  A document's score is the
calibrated machine value of its worst string.  All landmarks fold into one weight per hashed subsequence, so
a string is scored without visiting landmarks, once per distinct word.

Defined results: an empty or null text has no string and gets the value of a string without subsequences; labels
other than 0 and 1 are not learned from; without labels of both classes every score is 0.  Repeated rows
are scored alike, very long texts whole; an empty table gives no rows; an input column named like the result gives way to it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import fold, sample_windows, training_rows
from .textkit import U64, SpanHasher, bounds, text_slices, word_spans
from .wordcache import WordValues


@dataclass(frozen=True)
class ToxicityConfig:
    decay: float = 0.6
    reach: int = 3                   # largest distance between neighbouring characters of a subsequence
    buckets_bits: int = 20
    landmarks: int = 160
    rounds: int = 3
    penalty: float = 1e-4
    negatives: int = 20000
    sample_per_class: int = 1500     # bounded training sample of labelled documents, per class
    windows: int = 8                 # of a training text, spread over all of it; scoring always reads whole texts
    window_chars: int = 2048
    seed: int = 11


#: Strings whose subsequences are in memory at once, and numbers in a piece of the kernel's expansion.
_STRINGS, _EXPANDED = 8192, 1 << 22
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: Letters, digits and all bytes of other scripts; the rest is punctuation that a string drops.
KEPT = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])


def framed(data: np.ndarray, word_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded strings without punctuation, each between ``<`` and ``>``."""
    keep = KEPT[data]
    kept = np.concatenate(([0], np.cumsum(keep)))[word_bounds]
    size = np.diff(kept) + 2
    out_bounds = bounds(size)
    out = np.empty(int(out_bounds[-1]), np.uint8)
    out[out_bounds[:-1]], out[out_bounds[1:] - 1] = ord("<"), ord(">")
    inside = np.ones(len(out), bool)
    inside[out_bounds[:-1]] = inside[out_bounds[1:] - 1] = False
    out[inside] = LOWER[data[keep]]
    return out, out_bounds


def subsequences(data: np.ndarray, word_bounds: np.ndarray, cfg: ToxicityConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, weight, string) of all three-character subsequences of the framed strings within ``reach``."""
    data, word_bounds = framed(data, word_bounds)
    codes = data.astype(np.uint64)
    size = np.diff(word_bounds)
    string = np.repeat(np.arange(len(size)), size)
    room = np.repeat(word_bounds[1:], size) - np.arange(len(codes))
    found, weights, owner = [], [], []
    for a in range(1, cfg.reach + 1):
        for b in range(1, cfg.reach + 1):
            at = np.flatnonzero(room > a + b)
            key = codes[at] << U64(16) | codes[at + a] << U64(8) | codes[at + a + b]
            found.append((key * U64(0x9E3779B97F4A7C15) >> U64(64 - cfg.buckets_bits)).astype(np.int64))
            weights.append(np.full(len(at), cfg.decay ** (a + b - 2), np.float32))
            owner.append(string[at])
    return np.concatenate(found), np.concatenate(weights), np.concatenate(owner)


def _packed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), bounds(np.array([len(w) for w in words], np.int64))


def values(data: np.ndarray, word_bounds: np.ndarray, table: np.ndarray, cfg: ToxicityConfig) -> np.ndarray:
    """Per string: sum of weight * table[bucket] over its subsequences, divided by the string's own weight."""
    n = len(word_bounds) - 1
    out = np.zeros(n)
    for lo in range(0, n, _STRINGS):                        # subsequences are ten times the strings' bytes and more
        hi = min(n, lo + _STRINGS)
        part = word_bounds[lo:hi + 1]
        bucket, weight, owner = subsequences(data[part[0]:part[-1]], part - part[0], cfg)
        own = np.sqrt(np.bincount(owner, weight * weight, hi - lo))
        out[lo:hi] = np.bincount(owner, weight * table[bucket], hi - lo) / np.maximum(own, 1e-9)
    return out


class _Kernel:
    """Kernels with a fixed list of landmark words."""

    def __init__(self, landmarks: list[bytes], cfg: ToxicityConfig):
        self.cfg = cfg
        bucket, weight, owner = subsequences(*_packed(landmarks), cfg)
        own = np.sqrt(np.bincount(owner, weight * weight, len(landmarks)))
        self.known, column = np.unique(bucket, return_inverse=True)
        self.matrix = np.zeros((len(self.known) + 1, len(landmarks)), np.float32)
        np.add.at(self.matrix, (column, owner), weight / own[owner])

    def __call__(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), self.matrix.shape[1]), np.float32)
        step = max(16, _EXPANDED // (64 * self.matrix.shape[1]))
        for lo in range(0, len(words), step):
            part = words[lo:lo + step]
            bucket, weight, owner = subsequences(*_packed(part), self.cfg)
            own = np.sqrt(np.bincount(owner, weight * weight, len(part)))
            at = np.searchsorted(self.known, bucket)
            at[at == len(self.known)] = 0
            hit = np.flatnonzero(self.known[at] == bucket)
            order = hit[np.argsort(owner[hit], kind="stable")]
            if len(order):
                rows = self.matrix[at[order]] * (weight[order] / own[owner[order]])[:, None]
                first = np.flatnonzero(np.concatenate(([True], owner[order][1:] != owner[order][:-1])))
                out[lo + owner[order][first]] = np.add.reduceat(rows, first)
        return out


def strings_of(text: str) -> list[bytes]:
    """Distinct strings of a text: lower-case words, and runs of three or more single letters as one."""
    words = text.encode().translate(LOWER.tobytes()).split()
    out, run = set(words), []
    for w in [*words, b""]:
        if len(w) == 1 and w.isalpha():
            run.append(w)
            continue
        if len(run) >= 3:
            out.add(b"".join(run))
        run = []
    return sorted(out)


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps on the rows inside the margin; the last weight is the bias."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype))).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-9
    for _ in range(20):
        active = y * (x @ w) < 1
        xa = x[active] * weight[active, None]
        new = np.linalg.solve(xa.T @ x[active] + np.diag(ridge), xa.T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _spelled_out(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with one character inserted, a copy of its neighbour or any other."""
    at = int(rng.integers(1, len(word)))
    mark = word[at:at + 1] if rng.random() < 0.5 else bytes([rng.choice(list(b"abcdefghijklmnopqrstuvwxyz0123456789"))])
    return word[:at] + mark + word[at:]


def train(texts: list[str], labels: list[int], cfg: ToxicityConfig = ToxicityConfig()):
    """(weight per hashed subsequence, bias, calibration slope and offset), or None without both classes."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(cfg.seed)
    unlike: dict[tuple, tuple[list[bytes], int]] = {}
    for text, label in zip(texts, labels):       # near copies share their smallest word hashes; one of them counts
        bag = strings_of(text)
        unlike.setdefault((label, *sorted(zlib.crc32(w) for w in bag)[:8]), (bag, label))
    toxic = [b for b, y in unlike.values() if y == 1 and b]
    clean = [b for b, y in unlike.values() if y == 0]
    in_toxic, in_clean = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    odds = {w: math.log((n + 0.1) / len(toxic)) - math.log((in_clean[w] + 0.5) / (len(clean) + 1)) for w, n in in_toxic.items()}
    long_enough = [w for w in odds if 3 <= len(w) <= 24]
    if not long_enough:
        return None
    ranked = sorted(long_enough, key=lambda w: (-odds[w] * math.sqrt(in_toxic[w]), w))[:8 * cfg.landmarks]
    near = _Kernel(ranked, cfg)(ranked)
    chosen: list[int] = []
    for i in range(len(ranked)):
        if len(chosen) < cfg.landmarks // 2 and odds[ranked[i]] > 0 and (not chosen or near[i, chosen].max() < 0.8):
            chosen.append(i)
    plain = sorted(w for w in in_clean if 3 <= len(w) <= 24)
    rest = [plain[i] for i in rng.permutation(len(plain))[:cfg.landmarks - len(chosen)]]
    kernel = _Kernel([ranked[i] for i in chosen] + rest, cfg)
    names = [ranked[i] for i in chosen] + rest
    gram = kernel(names).astype(np.float64)
    vals, vecs = np.linalg.eigh((gram + gram.T) / 2)
    root = vecs @ np.diag(1 / np.sqrt(np.maximum(vals, 1e-3))) @ vecs.T
    clean_words = sorted(in_clean)
    data, word_bounds = _packed(clean_words)
    bag_words = sorted(in_toxic)
    bag_data, bag_bounds = _packed(bag_words)
    place = {w: i for i, w in enumerate(bag_words)}
    bag_rows = [np.array([place[w] for w in b]) for b in toxic]
    current = np.array([odds[w] for w in bag_words])
    hard = rng.permutation(len(clean_words))[:cfg.negatives]
    often = max(5, 0.015 * len(toxic))
    marked = [w for w in long_enough if in_toxic[w] >= often and odds[w] >= math.log(20)]
    table, bias = None, 0.0
    for _ in range(cfg.rounds):
        best = Counter(bag_words[r[np.argmax(current[r])]] for r in bag_rows)
        for w in marked:
            best[w] = max(best[w], math.sqrt(in_toxic[w]))
        positives = sorted(w for w in best if len(w) >= 3)
        if not positives:
            return None
        spelled = [_spelled_out(w, rng) for w in positives for _ in range(2)]
        weight = [float(best[w]) for w in positives] + [0.25 * best[w] for w in positives for _ in range(2)]
        negatives = [clean_words[i] for i in hard]
        x = kernel(positives + spelled + negatives) @ root
        y = np.concatenate((np.ones(len(positives) + len(spelled)), -np.ones(len(negatives))))
        share = np.concatenate((np.array(weight) / sum(weight), np.full(len(negatives), 1 / max(1, len(negatives)))))
        w = _machine(x, y, share, cfg.penalty)
        beta = root @ w[:-1]
        table = np.zeros(1 << cfg.buckets_bits, np.float32)
        table[kernel.known] = kernel.matrix[:-1] @ beta
        bias = float(w[-1])
        current = values(bag_data, bag_bounds, table, cfg) + bias
        f = values(data, word_bounds, table, cfg) + bias
        hard = np.unique(np.concatenate((hard[:cfg.negatives // 2], np.argsort(-f)[:cfg.negatives // 4])))
    toxic_top = np.array([current[r].max() for r in bag_rows])
    at = {w: i for i, w in enumerate(clean_words)}
    clean_top = np.array([f[[at[w] for w in b]].max() if b else bias for b in clean])
    slope, offset = _calibrate(toxic_top, clean_top)
    return table, bias, slope, offset


def _calibrate(high: np.ndarray, low: np.ndarray) -> tuple[float, float]:
    """Platt scaling with classes of equal weight, by gradient steps on (slope, offset)."""
    x = np.concatenate((high, low))
    y = np.concatenate((np.full(len(high), 1 - 1 / (len(high) + 2)), np.full(len(low), 1 / (len(low) + 2))))
    w = np.concatenate((np.full(len(high), 0.5 / max(1, len(high))), np.full(len(low), 0.5 / max(1, len(low)))))
    a = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a[0] * x + a[1])))
        g = np.array([((p - y) * w * x).sum(), ((p - y) * w).sum()]) + 1e-4 * np.array([a[0], 0])
        h = p * (1 - p) * w
        m = np.array([[(h * x * x).sum(), (h * x).sum()], [(h * x).sum(), h.sum()]]) + 1e-4 * np.eye(2)
        a = a - np.clip(np.linalg.solve(m, g), -2, 2)
    return float(a[0]), float(a[1])


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig(), folds: int = 5):
    rows = training_rows(docs, labels, "toxic", lambda c: fold(c, folds) == 0, cfg.sample_per_class).select(
        sample_windows(F.col("text"), F.col("id"), cfg.windows, cfg.window_chars).alias("text"), "label").toArrow()
    return train(rows["text"].to_pylist(), rows["label"].to_pylist(), cfg)


class Scorer:
    def __init__(self, model, cfg: ToxicityConfig):
        self.cfg, self.model = cfg, model
        if model is not None:
            self.table, self.bias, self.slope, self.offset = model
            self.words = WordValues(lambda d, b: values(d, b, self.table, cfg)[:, None], 1)

    def _letter_runs(self, data, start, end, doc, top) -> None:
        """Runs of three or more one-letter words count as one string more."""
        one = (end - start == 1) & ((data[start] | 32) >= ord("a")) & ((data[start] | 32) <= ord("z"))
        if not one.any():
            return
        at = np.flatnonzero(one)
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        keep = size >= 3
        if keep.any():
            pick = np.repeat(keep, size)
            f = values(data[start[at[pick]]], bounds(size[keep]), self.table, self.cfg)
            np.maximum.at(top, doc[at[first[keep]]], f)

    def __call__(self, texts) -> np.ndarray:
        n = len(texts)
        if self.model is None:
            return np.zeros(n)
        out = np.zeros(n)
        for lo, hi, data, offs in text_slices(texts):
            start, end, doc = word_spans(data, offs)
            top = np.full(hi - lo, -np.inf)
            if len(start):
                f = self.words(data, start, end, SpanHasher(data, fold_case=True)(start, end))[:, 0]
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                top[doc[first]] = np.maximum.reduceat(f, first)
                self._letter_runs(data, start, end, doc, top)
            out[lo:hi] = np.where(np.isinf(top), 0.0, top)
        return 1 / (1 + np.exp(-(self.slope * (out + self.bias) + self.offset)))


def score(docs: DataFrame, model, cfg: ToxicityConfig = ToxicityConfig(), text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a toxicity score column added."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)      # fixed size: one float per bucket
    docs = docs.drop(out)                                          # a column of that name gives way
    schema = docs.withColumn(out, F.lit(0.0)).schema

    def run(batches):
        scorer = Scorer(shipped.value, cfg)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer(batch.column(at)), pa.float64())],
                                             names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)
