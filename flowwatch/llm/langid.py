"""Operator 5: language identification by a byte convolutional network.

Texts are cut into fixed windows of bytes (folded to ASCII lower case, the last one padded).  Bytes are embedded, filters of
several widths slide over the window, each filter's largest response feeds a softmax layer.  Embedding,
filters and layer are trained in numpy (Adam) on labelled text.  A text's prediction is the average of the
log probabilities of all its windows, weighed by their bytes, so the whole text counts.

Defined results: null, empty and letterless texts are ``und`` with score 0; with nothing to learn from
every text is.  Ties go to the language first in code point order.  Repeated rows are scored alike, very long texts whole, window by
window; an empty table gives no rows; input columns named like the results give way to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import fold, sample_windows
from .textkit import text_slices
from .toxicity import LOWER

UNKNOWN = "und"


@dataclass(frozen=True)
class LangConfig:
    window: int = 192
    dims: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16                # of each width
    epochs: int = 4
    batch: int = 64
    rate: float = 0.01
    sample_per_lang: int = 300       # bounded training sample of labelled rows, per language
    sample_windows: int = 8          # of a training text, spread over all of it; prediction always reads whole texts
    seed: int = 5


class Network:
    def __init__(self, langs: list[str], cfg: LangConfig):
        self.langs, self.cfg = langs, cfg
        rng = np.random.default_rng(cfg.seed)
        n = len(cfg.widths) * cfg.filters
        self.reach = max(cfg.widths)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, cfg.dims)).astype(np.float32),
            "filter": rng.normal(0, 0.3, (self.reach * cfg.dims, n)).astype(np.float32),
            "shift": np.zeros(n, np.float32),
            "layer": np.zeros((n, len(langs)), np.float32),
            "bias": np.zeros(len(langs), np.float32),
        }
        self.mask = np.zeros_like(self.p["filter"])       # a narrow filter is a wide one with zero rows
        for i, width in enumerate(cfg.widths):
            self.mask[:width * cfg.dims, i * cfg.filters:(i + 1) * cfg.filters] = 1
        self.p["filter"] *= self.mask

    def _spans(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, reach * dims): the embedded bytes under the filters at every position."""
        padded = np.pad(x, ((0, 0), (0, self.reach - 1)))
        e = self.p["embed"][padded]
        s = np.lib.stride_tricks.as_strided(
            e, (len(x), x.shape[1], self.reach * self.cfg.dims), (e.strides[0], e.strides[1], e.strides[2]))
        return s

    def pooled(self, x: np.ndarray) -> np.ndarray:
        s = np.ascontiguousarray(self._spans(x)).reshape(-1, self.reach * self.cfg.dims)
        r = (s @ self.p["filter"]).reshape(len(x), x.shape[1], -1)
        return np.maximum(r.max(1) + self.p["shift"], 0)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.p["layer"] + self.p["bias"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cfg, p = self.cfg, self.p
        spans = np.ascontiguousarray(self._spans(x))
        r = spans @ p["filter"]
        top = r.argmax(1)
        h = np.take_along_axis(r, top[:, None, :], 1)[:, 0] + p["shift"]
        on = h > 0
        h = np.where(on, h, 0)
        z = h @ p["layer"] + p["bias"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(len(y)), y] -= 1
        q /= len(y)
        back = (q @ p["layer"].T) * on
        under = spans[np.arange(len(x))[:, None], top]                 # (windows, filters, reach * dims)
        g = {"layer": h.T @ q, "bias": q.sum(0), "shift": back.sum(0),
             "filter": np.einsum("bf,bfk->kf", back, under) * self.mask}
        into = (back[:, :, None] * p["filter"].T[None]).reshape(len(x), len(p["shift"]), self.reach, cfg.dims)
        padded = np.pad(x, ((0, 0), (0, self.reach - 1)))
        seen = padded[np.arange(len(x))[:, None, None], top[:, :, None] + np.arange(self.reach)]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], seen.ravel(), into.reshape(-1, cfg.dims))
        return g

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        cfg = self.cfg
        rng = np.random.default_rng(cfg.seed + 1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        epochs = max(cfg.epochs, -(-300 * cfg.batch // max(1, len(x))))     # a small sample still gets 300 steps
        steps, t = epochs * -(-len(x) // cfg.batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), cfg.batch):
                pick = order[lo:lo + cfg.batch]
                t += 1
                rate = cfg.rate * (1 - t / (steps + 1))
                for k, g in self.gradients(x[pick], y[pick]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-7)).astype(np.float32)


def windows(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of every window, its text, bytes in it); the last window of a text is padded with zeros."""
    length = np.diff(offs)
    count = -(-length // size)
    text = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offs[text] + nth * size
    held = np.minimum(size, offs[text + 1] - start)
    at = start[:, None] + np.arange(size)
    inside = np.arange(size) < held[:, None]
    x = np.where(inside, LOWER[data[np.minimum(at, len(data) - 1)]], 0).astype(np.uint8) if len(data) else np.zeros((0, size), np.uint8)
    return x, text, held


def fit(docs: DataFrame, cfg: LangConfig = LangConfig(), folds: int = 3, held: int = 1) -> Network | None:
    """Learns from text and non-null lang of the documents outside the held-out fold: so many per language by hash order."""
    by_lang = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = (docs.select("doc_id", "text", "lang")
            .where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
            .where(fold(F.col("doc_id"), folds) != held)
            .withColumn("text", sample_windows(F.col("text"), F.col("doc_id"), cfg.sample_windows, cfg.window))
            .withColumn("nth", F.row_number().over(by_lang)).where(F.col("nth") <= cfg.sample_per_lang)
            .orderBy("lang", "nth").select("lang", "text").toArrow())
    names = rows["lang"].to_pylist()
    langs = sorted(set(names))
    if not langs:
        return None
    xs, ys = [], []
    of = np.array([langs.index(n) for n in names])
    for lo, hi, data, offs in text_slices(rows["text"]):
        x, text, size = windows(data, offs, cfg.window)
        keep = size >= 16
        xs.append(x[keep])
        ys.append(of[lo:hi][text[keep]])
    net = Network(langs, cfg)
    if sum(map(len, xs)):
        net.train(np.concatenate(xs), np.concatenate(ys))
    return net


def _has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A text with an ASCII letter has one; only the others are looked at character by character."""
    ascii_letter = ((data | 32) >= ord("a")) & ((data | 32) <= ord("z"))
    seen = np.concatenate(([0], np.cumsum(ascii_letter)))
    out = seen[offs[1:]] > seen[offs[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[i] = any(c.isalpha() for c in data[offs[i]:offs[i + 1]].tobytes().decode())
    return out


class Predictor:
    def __init__(self, net: Network | None):
        self.net = net

    def __call__(self, texts) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        names, scores = [UNKNOWN] * n, np.zeros(n)
        if self.net is None:
            return names, scores
        for lo, hi, data, offs in text_slices(texts, 1 << 20):
            letter = _has_letter(data, offs)
            x, text, held = windows(data, offs, self.net.cfg.window)
            total = np.zeros((hi - lo, len(self.net.langs)))
            for a in range(0, len(x), 256):
                part = self.net.log_probs(x[a:a + 256]) * held[a:a + 256, None]
                np.add.at(total, text[a:a + 256], part)
            mean = total / np.maximum(np.diff(offs), 1)[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for i in np.flatnonzero(letter):
                names[lo + i] = self.net.langs[best[i]]
                scores[lo + i] = p[i, best[i]]
        return names, scores


def predict(docs: DataFrame, net: Network | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability added."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)        # fixed size: the network's weights
    docs = docs.drop(lang, score)                                  # columns of these names give way
    schema = docs.withColumn(lang, F.lit("")).withColumn(score, F.lit(0.0)).schema

    def run(batches):
        predictor = Predictor(shipped.value)
        for batch in batches:
            names, scores = predictor(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, lang, score])

    return docs.mapInArrow(run, schema)
