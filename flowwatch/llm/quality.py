"""Operator 3: quality classifier on supervised subword embeddings.

A document is the average of learned hashed vectors: one per word, per word pair and per character n-gram
(3 to 5 bytes of ``<word>``); a softmax layer on the average gives the classes.  A pair of equal words has one
vector of its own, whatever the word.  Vectors and layer are trained together by numpy stochastic gradient descent.

As the layer is linear, a trained model scores through one number per hashed feature, and the sum over the
features of a word is computed once per distinct word.

Defined results: an empty or null text has no features and gets the score of the zero average (the
layer's bias); documents labelled with a null or any value but 0 and 1 are not learned from; without labels of
both classes every score is 0.5.  Rows are scored one by one: repeated rows and ids are scored alike, very long texts whole; an
empty table gives no rows.  An input column named like the result gives way to it in ``score``; ``keep_good`` returns all columns as
they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U64, SpanHasher, bounds, counts_per_doc, mix64, text_slices, word_spans
from .wordcache import WordValues


@dataclass(frozen=True)
class QualityConfig:
    buckets_bits: int = 18
    dims: int = 10
    ngrams: tuple[int, ...] = (3, 4, 5)
    updates: int = 8000              # documents visited by gradient descent, half of them of either class
    rate: float = 0.6
    sample_per_class: int = 800      # bounded training sample of labelled rows, per class
    windows: int = 8                 # of a training text, spread over all of it; scoring always reads whole texts
    window_chars: int = 2048
    seed: int = 7


#: Bytes of training texts whose n-grams are in memory at once: a slice takes some hundred times its size.
_TRAIN_SLICE = 1 << 17


def fold(doc_id, modulus: int) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def _ngram_buckets(data: np.ndarray, word_bounds: np.ndarray, cfg: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the word itself and of all character n-grams of ``<word>``."""
    n = len(word_bounds) - 1
    size = np.diff(word_bounds) + 2
    framed_bounds = bounds(size)
    framed = np.empty(int(framed_bounds[-1]), np.uint8)
    framed[framed_bounds[:-1]], framed[framed_bounds[1:] - 1] = ord("<"), ord(">")
    inside = np.ones(len(framed), bool)
    inside[framed_bounds[:-1]] = inside[framed_bounds[1:] - 1] = False
    framed[inside] = data
    hasher = SpanHasher(framed)
    words = np.arange(n)
    found, owner = [hasher(framed_bounds[:-1], framed_bounds[1:])], [words]
    word_of = np.repeat(words, size)
    room = np.repeat(framed_bounds[1:], size) - np.arange(len(framed))
    for k in cfg.ngrams:
        at = np.flatnonzero(room >= k)
        found.append(hasher.rolling(at, at + k))
        owner.append(word_of[at])
    return (np.concatenate(found) >> U64(64 - cfg.buckets_bits)).astype(np.int64), np.concatenate(owner)


def _pair_buckets(hashes: np.ndarray, doc: np.ndarray, cfg: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of neighbouring words; bucket 0 is the pair of equal words."""
    same_doc = np.flatnonzero(doc[1:] == doc[:-1])
    a, b = hashes[same_doc], hashes[same_doc + 1]
    bucket = (mix64(a * U64(0xD6E8FEB86659FD93) + b) >> U64(64 - cfg.buckets_bits)).astype(np.int64)
    bucket[a == b] = 0
    return bucket, doc[same_doc]


def _features(texts: pa.Array, cfg: QualityConfig) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and the share of each."""
    out = []
    for lo, hi, data, offs in text_slices(texts, _TRAIN_SLICE):
        start, end, doc = word_spans(data, offs)
        if len(start) == 0:
            out += [(np.zeros(0, np.int32), np.zeros(0, np.float32))] * (hi - lo)
            continue
        hashes = SpanHasher(data)(start, end)
        size = end - start
        word_bounds = bounds(size)
        at = np.arange(word_bounds[-1]) + np.repeat(start - word_bounds[:-1], size)
        bucket, word = _ngram_buckets(data[at], word_bounds, cfg)
        pair, pair_doc = _pair_buckets(hashes, doc, cfg)
        key = np.concatenate((doc[word], pair_doc)) << cfg.buckets_bits | np.concatenate((bucket, pair))
        distinct, count = np.unique(key, return_counts=True)
        of = distinct >> cfg.buckets_bits
        cut = np.searchsorted(of, np.arange(hi - lo + 1))
        for a, b in zip(cut[:-1], cut[1:]):
            share = count[a:b] / max(1, count[a:b].sum())
            out.append(((distinct[a:b] & ((1 << cfg.buckets_bits) - 1)).astype(np.int32), share.astype(np.float32)))
    return out


def train(texts: list[str], labels: list[int], cfg: QualityConfig = QualityConfig()) -> tuple[np.ndarray, float] | None:
    """One weight per hashed feature and a bias: log odds of class 1 = bias + mean of weights."""
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(cfg.seed)
    rows = _features(pa.array(texts, pa.large_string()), cfg)
    vectors = rng.uniform(-1 / cfg.dims, 1 / cfg.dims, (1 << cfg.buckets_bits, cfg.dims)).astype(np.float32)
    layer = np.zeros((cfg.dims, 2), np.float32)
    bias = np.zeros(2, np.float32)
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    for step in range(cfg.updates):
        i = rng.choice(classes[step & 1])
        rate = np.float32(cfg.rate * (1 - step / cfg.updates))
        index, share = rows[i]
        mean = share @ vectors[index]
        z = mean @ layer + bias
        p = np.exp(z - z.max())
        grad = p / p.sum()
        grad[y[i]] -= 1
        vectors[index] -= rate * share[:, None] * (layer @ grad)
        layer -= rate * np.outer(mean, grad)
        bias -= rate * grad
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, target: str, held_out, per_class: int) -> DataFrame:
    """(text, label): a bounded sample of labelled rows outside the held-out fold, so many per class by hash order.

    Of rows that repeat an id one label is taken.  The sample's size is a parameter; it does not follow the corpus.
    """
    known = (labels.select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & F.col("id").isNotNull()).where(~held_out(F.col("id")))
             .groupBy("id").agg(F.min("label").alias("label")).withColumn("draw", F.xxhash64("id")))
    picked = known.where("label = 0").orderBy("draw", "id").limit(per_class).union(
        known.where("label = 1").orderBy("draw", "id").limit(per_class))
    return (docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(picked), "id")
            .groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label").orderBy("id"))


def sample_windows(text, draw, count: int, size: int) -> F.Column:
    """A text of bounded length to learn from: one up to count * size characters as it is, of a longer one ``count`` windows
    of ``size`` characters, one in each of ``count`` even stretches at a place drawn by hash."""
    text = F.coalesce(text, F.lit(""))
    stretch = (F.length(text) / count).cast("long")

    def window(i):
        place = i * stretch + F.pmod(F.xxhash64(draw, i), stretch - size + 1)
        return F.substring(text, place.cast("int") + 1, F.lit(size))

    cut = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), window), " ")
    return F.when(F.length(text) <= count * size, text).otherwise(cut)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", cfg: QualityConfig = QualityConfig(),
        folds: int = 5):
    rows = training_rows(docs, labels, target, lambda c: fold(c, folds) == 0, cfg.sample_per_class).select(
        "id", sample_windows(F.col("text"), F.col("id"), cfg.windows, cfg.window_chars).alias("text"), "label")

    def learn(batches):
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(1).to_pylist()
            marks += batch.column(2).to_pylist()
        model = train(texts, marks, cfg)
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([model[0].astype("<f4").tobytes()], pa.binary()), pa.array([model[1]], pa.float64())],
                                             ["weights", "bias"])

    # the sample is bounded, so one task learns from it; the driver gets one float per bucket
    found = rows.repartition(1).sortWithinPartitions("id").mapInArrow(learn, "weights binary, bias double").collect()
    return (np.frombuffer(found[0].weights, "<f4"), found[0].bias) if found else None


class Scorer:
    def __init__(self, model: tuple[np.ndarray, float] | None, cfg: QualityConfig):
        self.cfg, self.model = cfg, model
        if model is not None:
            self.weight = model[0].astype(np.float32)
            self.values = WordValues(self._word, 2)

    def _word(self, data: np.ndarray, word_bounds: np.ndarray) -> np.ndarray:
        bucket, word = _ngram_buckets(data, word_bounds, self.cfg)
        n = len(word_bounds) - 1
        return np.stack((np.bincount(word, self.weight[bucket], n), np.bincount(word, minlength=n)), 1)

    def __call__(self, texts) -> np.ndarray:
        n = len(texts)
        if self.model is None:
            return np.full(n, 0.5)
        total, count = np.zeros(n), np.zeros(n)
        for lo, hi, data, offs in text_slices(texts):
            start, end, doc = word_spans(data, offs)
            if len(start) == 0:
                continue
            hashes = SpanHasher(data)(start, end)
            value = self.values(data, start, end, hashes)
            pair, pair_doc = _pair_buckets(hashes, doc, self.cfg)
            m = hi - lo
            total[lo:hi] = np.bincount(doc, value[:, 0], m) + np.bincount(pair_doc, self.weight[pair], m)
            count[lo:hi] = np.bincount(doc, value[:, 1], m) + counts_per_doc(pair_doc, m)
        return 1 / (1 + np.exp(-(self.model[1] + total / np.maximum(count, 1))))


def score(docs: DataFrame, model, cfg: QualityConfig = QualityConfig(), text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score column (probability of class 1) added."""
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


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    mark = "quality_score"
    while mark in docs.columns:
        mark += "_"
    return score(docs, fit(docs, labels, "quality", cfg), cfg, out=mark).where(F.col(mark) >= threshold).drop(mark)
