"""Operator 6: n-gram Jaccard join of documents by a prefix tree, and the groups that its links form.

A document's set holds the hashes of its distinct word shingles.  Two sets with a Jaccard similarity of ``percent`` / 100 share
one of the first few of their n-grams in any global order; rare n-grams first keeps the lists short.  The order's
frequency classes come from exact counts over all documents, kept in a table of fixed size (hash slots; the order only has to be the
same everywhere, so slots that n-grams share cost nothing but speed).  Documents that share such an n-gram
and may reach the similarity by length, position and an exact bound on the overlap form families.

Each family's sets are joined by a trie over the globally ordered sets: sorted sets are its depth-first order, nodes carry the
overlap of their path with every other set, so common prefixes are counted once; subtrees in which no set can
reach the similarity with what remains, or that are linked already, are skipped.  Links are kept as a spanning forest.

Equal sets (by a 128-bit digest) are one node, joined once, whatever their rows' ids.

Defined results: null and empty texts have empty sets and stay alone; rows that share a doc_id but not the text are documents
of their own, each in the group of its own text, under the smallest doc_id there; a null doc_id takes no part and has a null
component; very long texts are taken whole; columns but doc_id and text are left out by ``grouped`` and kept by ``keep_one``,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import families
from .components import components
from .textkit import U64, SpanHasher, bounds, counts_per_doc, mix64, shingle_hashes, text_slices, word_spans
from .workspace import Workspace

_ORDER_BITS = 22               # slots of the table of frequency classes
_COUNTED = 6                   # bytes of a hash that are counted for the order
_RANGES = 128                  # ranges of the hash space in the overlap bound
SET = ["d1", "d2", "n"]        # what names a set


@dataclass(frozen=True)
class JoinConfig:
    width: int = 4
    percent: int = 85
    block_weight: int = 1 << 20      # n-grams of a block of a family


def sets_of(texts, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles, words folded to ASCII lower case."""
    out = []
    for lo, hi, data, offs in text_slices(texts):
        start, end, doc = word_spans(data, offs)
        h = SpanHasher(data, fold_case=True)(start, end) if len(start) else np.zeros(0, np.uint64)
        out += shingle_hashes(h, bounds(counts_per_doc(doc, hi - lo)), width)
    return out


def frequency_classes(docs: DataFrame, cfg: JoinConfig) -> np.ndarray:
    """One byte per slot of the hash space: 0 for n-grams in fewer than 16 documents, then a step for each doubling."""
    buckets = families.bucket_count(docs)
    shift = U64(64 - (buckets - 1).bit_length())

    def count(batches):
        held, waiting = [], 0

        def flush():
            every, times = np.unique(np.concatenate(held), return_counts=True)       # a frequent n-gram travels once a task
            often = np.flatnonzero(times > 1)
            parts = []
            for one in (every, every[often]):
                cut = np.searchsorted(one >> shift, np.arange(buckets + 1).astype(np.uint64)).tolist()
                parts.append((one.view(np.uint8).reshape(-1, 8)[:, 8 - _COUNTED:], cut))
            (raw, cut), (more, more_cut) = parts
            extra = (times[often] - 1).astype("<u4")
            rows = [(b, raw[x:y].tobytes(), more[u:v].tobytes(), extra[u:v].tobytes()) for b, (x, y, u, v)
                    in enumerate(zip(cut[:-1], cut[1:], more_cut[:-1], more_cut[1:])) if y > x]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                               *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))],
                                              names=["bucket", "hashes", "more", "extra"])

        for batch in batches:
            for one in sets_of(batch.column(0), cfg.width):
                held.append(one)
                waiting += len(one)
                if waiting > 2_000_000:
                    yield flush()
                    held, waiting = [], 0
        if waiting:
            yield flush()

    def widened(column) -> np.ndarray:
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _COUNTED)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, 8 - _COUNTED:] = raw
        return wide.view(np.uint64).ravel()

    def classes(key, table):
        every, times = np.unique(widened(table["hashes"]), return_counts=True)
        extra = np.frombuffer(b"".join(table["extra"].to_pylist()), "<u4").astype(np.int64)
        np.add.at(times, np.searchsorted(every, widened(table["more"])), extra)
        often = np.flatnonzero(times >= 16)
        per = (1 << _ORDER_BITS) // buckets
        base = key[0].as_py() * per
        out = np.zeros(per, np.uint8)
        slot = (every[often] >> U64(64 - _ORDER_BITS)).astype(np.int64) - base
        np.maximum.at(out, slot, np.log2(times[often]).astype(np.uint8) - 3)
        return pa.table({"at": pa.array([base], pa.int64()), "bytes": pa.array([out.tobytes()], pa.binary())})

    counted = docs.select("text").mapInArrow(count, "bucket int, hashes binary, more binary, extra binary")
    return families.fixed_table(counted.groupBy("bucket").applyInArrow(classes, "at long, bytes binary"), 1 << _ORDER_BITS)


def least_overlap(a, b, percent: int):
    """Smallest intersection of sets of sizes a and b with the similarity."""
    return -((-percent * (a + b)) // (100 + percent))


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if len(s) == 0:
        return 0, 0
    return int(mix64(s).sum().astype(np.int64)), int(mix64(s ^ U64(0xA5A5A5A55A5A5A5A)).sum().astype(np.int64))


def described(docs: DataFrame, classes: np.ndarray, cfg: JoinConfig) -> DataFrame:
    """(doc_id, n, d1, d2, ranges, prefix): set size, 128-bit digest, n-grams per hash range, and the first n-grams of the
    global order among which any similar set has one too."""
    shipped = docs.sparkSession.sparkContext.broadcast(classes)    # 2^_ORDER_BITS bytes

    def run(batches):
        table = shipped.value
        for batch in batches:
            n, d1, d2, ranges, prefix = [], [], [], [], []
            for s in sets_of(batch.column(1), cfg.width):
                n.append(len(s))
                digest = _digest(s)
                d1.append(digest[0])
                d2.append(digest[1])
                count = np.bincount((s >> U64(57)).astype(np.int64), minlength=_RANGES)
                ranges.append(np.minimum(count, 65535).astype("<u2").tobytes())
                keep = len(s) - (cfg.percent * len(s) + 99) // 100 + 1 if len(s) else 0
                rare = np.argsort(table[(s >> U64(64 - _ORDER_BITS)).astype(np.int64)], kind="stable")[:keep]
                prefix.append(s[rare].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(ranges, pa.binary()), pa.array(prefix, pa.binary())],
                names=["doc_id", "n", "d1", "d2", "ranges", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, d1 long, d2 long, ranges binary, prefix binary")


def _may_pair(percent: int):
    def check(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = x["size"].astype(np.int64), y["size"].astype(np.int64)
        fits = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        return fits & (np.minimum(a - x["place"], b - y["place"]) >= least_overlap(a, b, percent))
    return check


def _candidate_edges(classes: DataFrame, cfg: JoinConfig, ws: Workspace) -> DataFrame:
    buckets = families.bucket_count(classes)

    def pack(batches):
        packer = families.Packer(buckets)
        for batch in batches:
            for node, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keys = np.frombuffer(raw, np.uint64)
                part = np.empty(len(keys), families.SIZED_ENTRY)
                part["key"], part["node"], part["size"], part["place"] = keys, node, n, np.arange(len(keys))
                yield from packer.add(part)
        yield from packer.flush()

    found = ws.table(families.edges(classes.select("node", "n", "prefix").mapInArrow(pack, families.PACKED),
                                    families.SIZED_ENTRY, _may_pair(cfg.percent)), "candidates")
    side = lambda name: classes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"),        # noqa: E731
                                       F.col("ranges").alias(f"ranges_{name}"))

    def bounded(batches):
        """Pairs whose n-grams per hash range leave room for the overlap: an upper bound, so no pair is lost."""
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, _RANGES).astype(np.int64) for i in (4, 5))
            most = np.minimum(x, y).sum(1)
            full = ((x == 65535) & (y == 65535)).any(1)
            ok = full | (most >= least_overlap(na, nb, cfg.percent))
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    pairs = (found.where(~F.col("star")).join(side("a"), "a").join(side("b"), "b")
             .select("a", "b", "n_a", "n_b", "ranges_a", "ranges_b").mapInArrow(bounded, "a long, b long"))
    return pairs.union(found.where("star").select("a", "b"))


class _Tree:
    """Sets of one group in the trie's depth-first order."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        cut = bounds(self.size)
        every, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(every), np.int64)
        order = np.argsort(-times, kind="stable")             # one order for all sets: shared n-grams first, so paths meet
        rank[order] = np.arange(len(every))
        self.shared = int((times > 1).sum())
        ranks = rank[inverse]
        self.paths = [np.sort(ranks[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        owner = np.repeat(np.arange(len(sets)), self.size)
        self.holders = owner[np.argsort(ranks, kind="stable")]
        self.holder_cut = bounds(times[order])
        self.order = sorted(range(len(sets)), key=lambda i: self.paths[i].astype(">u4").tobytes())
        self.common = [0] * (len(sets) + 1)                   # common[i]: path shared by the i-th and the one before
        for i in range(1, len(sets)):
            p, q = self.paths[self.order[i - 1]], self.paths[self.order[i]]
            k = min(len(p), len(q))
            differ = np.flatnonzero(p[:k] != q[:k])
            self.common[i] = int(differ[0]) if len(differ) else k

    def overlap(self, part: np.ndarray) -> np.ndarray:
        """How many n-grams of a piece of a path each set holds."""
        part = part[:np.searchsorted(part, self.shared)]
        a, n = self.holder_cut[part], self.holder_cut[part + 1] - self.holder_cut[part]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.holders[at], minlength=len(self.size))


def tree_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets whose intersection is at least percent / 100 of their union."""
    if len(sets) < 2:
        return []
    tree = _Tree(sets)
    size, m = tree.size, len(sets)
    label = np.arange(m)
    links = []
    stack = [(0, np.zeros(m, np.int64))]
    i = 0
    while i < m:
        x = tree.order[i]
        while stack[-1][0] > tree.common[i]:
            stack.pop()
        depth, held = stack[-1]
        path, n = tree.paths[x], int(size[x])
        ahead = tree.common[i + 1]
        if ahead > depth:                                    # a node below which sets share the path so far
            held = held + tree.overlap(path[depth:ahead])
            depth = ahead
            stack.append((depth, held))
            end = i + 1
            while end < m and tree.common[end] >= depth:
                end += 1
            within = size[tree.order[i:end]]
            low, high = int(within.min()), int(within.max())
            able = (held + np.minimum(high - depth, size - held) >= least_overlap(low, size, percent))
            able[tree.order[i:end]] = True
            near = label[able]
            if (near == near[0]).all():
                i = end
                continue
        able = ((held + np.minimum(n - depth, size - held) >= least_overlap(n, size, percent))
                & (100 * np.minimum(n, size) >= percent * np.maximum(n, size)) & (label != label[x]))
        if able.any():
            total = held + tree.overlap(path[depth:])
            hit = np.flatnonzero(able & (100 * total >= percent * (n + size - total)))
            for y in hit:
                if label[y] != label[x]:
                    links.append((x, int(y)))
                    label[label == label[y]] = label[x]
        i += 1
    return links


def grouped(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    ws = Workspace(docs.sparkSession, "ngramjoin")
    every = ws.table(described(docs, frequency_classes(docs, cfg), cfg), "sets")
    known = every.where("n > 0 and doc_id is not null")
    classes = ws.table(known.groupBy(*SET).agg(                # numbered where they are written, once
        F.min("doc_id").alias("least"), F.first("ranges").alias("ranges"), F.first("prefix").alias("prefix"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    candidates = ws.table(_candidate_edges(classes, cfg, ws), "edges")
    dealt = families.blocks(candidates, classes.select("node", F.col("n").alias("weight")), ws, cfg.block_weight)
    dealt = ws.table(dealt.join(classes.select("node", "least", *SET), "node"), "blocks")

    def shingled(batches):
        for batch in batches:
            sets = [s for s in sets_of(batch.column(0), cfg.width) if len(s)]
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                 pa.array(list(map(len, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*SET, "content"])

    holders = dealt.select(F.col("least").alias("holder")).distinct()           # a document that has the set
    wanted = (docs.select(F.col("doc_id").cast("long").alias("holder"), "text").join(holders, "holder", "left_semi")
              .select("text").mapInArrow(shingled, "d1 long, d2 long, n long, content binary"))

    def join(members: list[int], contents: list[bytes]) -> list[tuple[int, int]]:
        found = tree_links([np.frombuffer(c, np.uint64) for c in contents], cfg.percent)
        return [(members[x], members[y]) for x, y in found]

    links = families.in_blocks(dealt.join(wanted, SET).select("family", "block", "other", "node", "content"), join)
    roots = ws.table(components(links, ws), "roots")
    rooted = ws.table(classes.join(roots, "node", "left").select(*SET, "least", F.coalesce("root", "node").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(first, "root").select(*SET, "component")
    return (every.select("doc_id", *SET).join(named, SET, "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their group, with all their columns; a null doc_id stays."""
    gone = "dropped_id"
    while gone in docs.columns:
        gone += "_"
    dropped = grouped(docs, cfg).where("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped[gone], "left_anti")
