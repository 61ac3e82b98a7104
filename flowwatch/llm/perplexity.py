"""Operator 8: quality rules with n-gram perplexity bands.

Base rules look at words and lines.  The method's verdict is the perplexity of a document's running text, its words with one
blank after each, under a byte n-gram model of its language (orders 1 to 5, across word borders), interpolated modified
Kneser-Ney.  Spark counts the n-grams of all documents: tasks count their own, partial counts are summed per (language, n-gram),
and continuation counts, discounts, probabilities and back-off weights are joins and aggregates over the n-gram table.  The
result keeps every n-gram's own key and grows with the corpus.  Scorers hold it as sorted arrays, at most ``PART`` n-grams at
a time: a larger table is dealt by hash into parts, each part scores the n-grams it has in a pass over the documents, and a
document's parts are summed.  All scored documents were counted, so no n-gram is missing.  A document is rejected outside its
language's band: ``reach`` half-spreads of that language's own documents away from their median log perplexity, where a
half-spread is the distance of the median from the quartile on that side.

Defined results: a null text is empty; texts without words have no perplexity and fall to the base rules; a null
language is a group of its own; a group with equal quartiles keeps the documents at the median;
repeated rows are judged alike, very long texts whole; columns but doc_id, text and lang are left out, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U64, SpanHasher, bounds, counts_per_doc, mix64, text_slices, word_spans
from .wordcache import gather_spans
from .workspace import Workspace

ORDER = 5
#: N-grams that a pass over the documents holds, about 12 bytes each.
PART = 1 << 22
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
NONE = "-"                     # language of documents without one
_OPEN = 0xFF                   # byte of the mark before a text, which UTF-8 never holds


@dataclass(frozen=True)
class BandConfig:
    reach: float = 6.0               # half-spreads from the median to either border


def _framed(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bounds, documents) of the texts that the words form: the opening mark, then each word with a blank."""
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    word_bounds = bounds(end - start + 1 + first)
    out = np.full(int(word_bounds[-1]), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[word_bounds[1:] - 1] = inside[word_bounds[:-1][first]] = False
    out[inside] = gather_spans(data, start, end)[0]
    out[word_bounds[:-1][first]] = _OPEN
    return out, np.append(word_bounds[:-1][first], len(out)), doc[first]


def _keys(framed: np.ndarray, text_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the n-gram that ends there, as long as the text allows up to ``ORDER`` bytes, its length in the high
    bits; and the position within the text."""
    size = np.diff(text_bounds)
    place = np.arange(len(framed)) - np.repeat(text_bounds[:-1], size)
    code = framed.astype(np.int64)
    key = code | np.minimum(place + 1, ORDER) << 40
    for k in range(1, ORDER):
        key[k:] |= np.where(place[k:] >= k, code[:len(code) - k] << (8 * k), 0)
    return key, place


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def raw_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) summed over all documents: full-order n-grams, and shorter ones that open a text."""
    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def flush():
            for lang, parts in held.items():
                k, n = _counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n, pa.int64())],
                                                 names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(1).fill_null(NONE).to_pylist(), object)
            for lo, hi, data, offs in text_slices(batch.column(0)):
                start, end, doc = word_spans(data, offs)
                if len(start) == 0:
                    continue
                names, code = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                of = code[doc]
                for c, name in enumerate(names):
                    mine = np.flatnonzero(of == c)
                    if len(mine) == 0:
                        continue
                    framed, text_bounds, _ = _framed(data, start[mine], end[mine], doc[mine])
                    keys, place = _keys(framed, text_bounds)
                    held.setdefault(str(name), []).append(np.unique(keys[place > 0], return_counts=True))  # the mark is given
                    waiting += len(held[str(name)][-1][0])
            if waiting > 4_000_000:
                yield from flush()
                waiting = 0
        yield from flush()

    return (docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _size(gram: str) -> F.Column:
    return F.shiftright(F.col(gram), 40)


def adjusted_counts(raw: DataFrame, ws: Workspace) -> DataFrame:
    """(lang, gram, n) of every order: raw counts at full order and for n-grams that open a text, else the number of
    different bytes before the n-gram."""
    table = raw.where(_size("gram") == ORDER)
    every = table
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << (8 * k)) - 1).bitwiseOR(F.lit(k << 40))
        table = table.groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n"))
        if k > 1:
            table = table.union(raw.where(_size("gram") == k))
        table = ws.table(table, f"order{k}")
        every = every.union(table)
    return every


def model_table(adjusted: DataFrame, ws: Workspace) -> DataFrame:
    """(lang, gram, logp): interpolated log probability of the n-grams that score a position: full ones, and shorter ones that
    open a text."""
    grams = ws.table(adjusted.withColumn("size", _size("gram").cast("int")).withColumn(
        "context", F.shiftright(F.col("gram").bitwiseAND((1 << 40) - 1), 8)), "grams")
    times = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    spread = grams.groupBy("lang", "size").agg(*times)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> F.Column:
        fits = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{i}") > 0)
        d = F.lit(float(i)) - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        return F.when(fits & (d > 0.05) & (d < i), d).otherwise(F.lit(0.5 * i)).alias(f"d{i}")

    cut = spread.select("lang", "size", discount(1), discount(2), discount(3))
    grams = grams.join(F.broadcast(cut), ["lang", "size"])     # one row per language and order
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    grams = ws.table(grams.withColumn("taken", taken).drop("d1", "d2", "d3"), "discounted")
    contexts = ws.table(grams.groupBy("lang", "size", "context").agg(
        F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("back")), "contexts")
    lower, every = None, None
    opens = F.expr(f"shiftright(gram & {(1 << 40) - 1}, 8 * (size - 1)) = {_OPEN}")
    for k in range(1, ORDER + 1):
        now = grams.where(F.col("size") == k).join(contexts, ["lang", "size", "context"])
        if lower is None:
            now = now.withColumn("below", F.lit(1.0 / 256))
        else:
            tail = F.col("gram").bitwiseAND((1 << (8 * (k - 1))) - 1)
            now = now.withColumn("tail", tail).join(
                lower.select(F.col("lang"), F.col("gram").bitwiseAND((1 << 40) - 1).alias("tail"), F.col("p").alias("below")),
                ["lang", "tail"], "left").withColumn("below", F.coalesce("below", F.lit(1.0 / 256)))
        now = now.select("lang", "size", "gram", ((F.col("n") - F.col("taken")) / F.col("total") + F.col("back") * F.col("below")).alias("p"))
        lower = ws.table(now, f"p{k}")
        every = lower if every is None else every.union(lower)
    return every.where((F.col("size") == ORDER) | opens).select("lang", "gram", F.log("p").cast("float").alias("logp"))


class Model:
    """Sorted n-grams of each language with their log probabilities: the whole table or a part of it."""

    def __init__(self, rows: pa.Table):
        lang, gram, logp = rows["lang"].combine_chunks().dictionary_encode(), rows["gram"].to_numpy(), rows["logp"].to_numpy()
        if isinstance(lang, pa.ChunkedArray):
            lang = lang.combine_chunks() if lang.num_chunks != 1 else lang.chunk(0)
        code = lang.indices.to_numpy()
        self.tables = {}
        for c, name in enumerate(lang.dictionary.to_pylist()):
            mine = np.flatnonzero(code == c)
            order = mine[np.argsort(gram[mine])]
            self.tables[name] = gram[order], logp[order]

    def texts(self, lang: str, framed: np.ndarray, text_bounds: np.ndarray) -> np.ndarray:
        """Minus log probability of each text's bytes as far as the table has them."""
        m = len(text_bounds) - 1
        grams, logp = self.tables.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.float32)))
        if len(grams) == 0:
            return np.zeros(m)
        keys, place = _keys(framed, text_bounds)
        at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
        value = np.where((grams[at] == keys) & (place > 0), logp[at], 0)
        return -np.bincount(np.repeat(np.arange(m), np.diff(text_bounds)), value, m)


def _base(data: np.ndarray, offs: np.ndarray, start, end, doc, hashes) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a slice's texts."""
    n = len(offs) - 1
    seen = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offs])          # noqa: E731
    points = (data & 0xC0) != 0x80
    solid = np.zeros(len(data) + 1, np.int64)
    solid[start] += 1
    solid[end] -= 1
    inside = np.cumsum(solid[:-1]) > 0
    # lines: spans between line feeds and text borders
    feed = np.flatnonzero(data == 0x0A)
    edges = np.unique(np.concatenate((feed + 1, offs)))
    line_start, line_end = edges[:-1], edges[1:].copy()
    cut = (line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 0x0A) if len(data) else np.zeros(0, bool)
    line_end[cut] -= 1
    words_before = np.concatenate(([0], np.cumsum(inside)))
    full = np.flatnonzero(words_before[line_end] > words_before[line_start])
    line_doc = np.searchsorted(offs, line_start[full], "right") - 1
    line_key = mix64(SpanHasher(data)(line_start[full], line_end[full]) + U64(0x9E3779B97F4A7C15) * line_doc.astype(np.uint64))
    _, first = np.unique(line_key, return_index=True)
    dup = counts_per_doc(line_doc, n) - counts_per_doc(line_doc[first], n)
    repeat = np.zeros(n, np.int64)
    if len(hashes) >= 3:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        key = hashes[at].copy()
        for k in (1, 2):
            key = mix64(key * U64(0xD6E8FEB86659FD93) + hashes[at + k])
        key = mix64(key + U64(0x9E3779B97F4A7C15) * doc[at].astype(np.uint64))
        order = np.argsort(key)
        same = np.concatenate(([False], key[order][1:] == key[order][:-1]))
        twice = np.zeros(len(key), bool)
        twice[order] = same | np.append(same[1:], False)
        in_window = np.zeros(len(hashes), bool)
        for k in range(3):
            in_window[at[twice] + k] = True
        repeat = np.bincount(doc, in_window, n).astype(np.int64)
    return [counts_per_doc(doc, n), seen(points & inside), seen(SYMBOLS[data]), dup, repeat]


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, tie long, nll double, size double"


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, base features, tie, nll, size) of every document: minus log probability of the n-grams that the model has, and
    the number of bytes; tie is xxhash64 of the text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)      # at most PART n-grams

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(2).fill_null(NONE).to_pylist(), object)
            for lo, hi, data, offs in text_slices(batch.column(1)):
                start, end, doc = word_spans(data, offs)
                m = hi - lo
                nll, size = np.zeros(m), np.zeros(m)
                hashes = SpanHasher(data)(start, end) if len(start) else np.zeros(0, np.uint64)
                names, code = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                of = code[doc]
                for c, name in enumerate(names):
                    mine = np.flatnonzero(of == c)
                    if len(mine):
                        framed, text_bounds, texts = _framed(data, start[mine], end[mine], doc[mine])
                        nll[texts] = shipped.value.texts(str(name), framed, text_bounds)
                        size[texts] = np.diff(text_bounds) - 1
                base = _base(data, offs, start, end, doc, hashes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, m), batch.column(2).slice(lo, m), *(pa.array(b, pa.int64()) for b in base),
                     batch.column(3).slice(lo, m), pa.array(nll, pa.float64()), pa.array(size, pa.float64())],
                    names=["doc_id", "lang", *(c.split()[0] for c in COLUMNS.split(", "))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"),
                       F.xxhash64("text").alias("tie")).mapInArrow(run, f"doc_id long, lang string, {COLUMNS}")


def measured(docs: DataFrame, table: DataFrame, ws: Workspace, part: int = PART) -> DataFrame:
    """(doc_id, lang, base features, nll) of every document; nll is the mean minus log probability per byte of its text.
    ``table`` is the n-gram table; a pass over the documents holds about ``part`` n-grams of it."""
    parts = max(1, -(-table.count() // part))
    dealt = F.pmod(F.xxhash64("lang", "gram"), F.lit(parts))
    rows, more = None, None
    for k in range(parts):
        now = _scored(docs, Model(table.where(dealt == k).toArrow()))
        if parts == 1:
            rows = now
            break
        now = ws.table(now, f"part{k}")
        if rows is None:
            rows = now
        else:                                                  # repeated rows score alike: one of them counts
            now = now.groupBy("doc_id", "lang", "tie").agg(F.max("nll").alias("more"))
            more = now if more is None else more.union(now)
    if more is not None:
        more = more.groupBy("doc_id", "lang", "tie").agg(F.sum("more").alias("more"))
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("doc_id", "lang", "tie")]
        rows = rows.alias("r").join(more.alias("m"), same, "left").select(
            *(F.col(f"r.{c}") for c in rows.columns if c != "nll"), (F.col("nll") + F.col("more")).alias("nll"))
    return rows.withColumn("nll", F.try_divide("nll", "size")).drop("tie", "size")


def build_model(docs: DataFrame, ws: Workspace) -> DataFrame:
    raw = ws.table(raw_counts(docs), "raw")
    return ws.table(model_table(adjusted_counts(raw, ws), ws), "model")


def judged(docs: DataFrame, cfg: BandConfig = BandConfig()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, nll, low, high)."""
    ws = Workspace(docs.sparkSession, "perplexity")
    rows = ws.table(measured(docs, build_model(docs, ws), ws).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "measured")
    group = F.coalesce("lang", F.lit(NONE)).alias("group")
    q = (rows.where(~F.col("base_failed")).groupBy(group)
         .agg(F.percentile_approx("nll", [0.25, 0.5, 0.75], 10000).alias("q")))
    bands = q.select(F.col("group"),
                     (F.col("q")[1] - cfg.reach * (F.col("q")[1] - F.col("q")[0])).alias("low"),
                     (F.col("q")[1] + cfg.reach * (F.col("q")[2] - F.col("q")[1])).alias("high"))
    return (rows.withColumn("group", group).join(F.broadcast(bands), "group", "left")     # one row per language
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("nll").between(F.col("low"), F.col("high")), F.lit(False)))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "nll", "low", "high"))
