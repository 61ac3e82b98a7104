"""Candidate edges between nodes that share a key, in linear space, and families of nodes with their blocks.

A join of nodes that share signature keys must not list all pairs of a frequent key.  Here a key with few holders gives its
pairs, a key with many gives a star around its smallest holder; either way nodes that share a key end up connected.
Families are the connected components.  Inside a family the caller's exact join runs, block against block, so nothing is
lost and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .workspace import Workspace

#: Holders of a key up to which all their pairs are listed.
FEW = 16
PACKED = "bucket int, entries binary, stars binary"
EDGES = "a long, b long, star boolean"
ENTRY = np.dtype([("key", "<u8"), ("node", "<i8")])
SIZED_ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("size", "<i4"), ("place", "<i4")])


def bucket_count(df: DataFrame) -> int:
    """Buckets for a shuffle about as wide as the input: a power of two, so it is known without counting rows."""
    return max(32, 1 << (2 * df.rdd.getNumPartitions() - 1).bit_length())


def _grouped(held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries in order of key and node without repeats, starts of the runs of a key, their lengths)."""
    held = held[np.lexsort((held["node"], held["key"]))]
    if len(held) == 0:
        return held, np.zeros(0, np.int64), np.zeros(0, np.int64)
    new_key = held["key"][1:] != held["key"][:-1]
    held = held[np.concatenate(([True], new_key | (held["node"][1:] != held["node"][:-1])))]
    first = np.flatnonzero(np.concatenate(([True], held["key"][1:] != held["key"][:-1])))
    return held, first, np.diff(np.append(first, len(held)))


def _stars(held: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(k, 2): the smallest node of every run above FEW with each other node of the run."""
    many = np.flatnonzero(size > FEW)
    hub = np.repeat(first[many], size[many])
    at = hub + np.arange(len(hub)) - np.repeat(np.cumsum(size[many]) - size[many], size[many])
    both = np.stack((held["node"][hub], held["node"][at]), 1)
    return both[both[:, 0] != both[:, 1]]


def _distinct(pairs: np.ndarray) -> np.ndarray:
    if len(pairs) == 0:
        return pairs.reshape(0, 2).astype(np.int64)
    pairs = np.sort(pairs, 1)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))]


class Packer:
    """Map side: collects entries, combines what a key holds too often already, and packs the rest by bucket of the key.

    A frequent key becomes a star here; only its hub and FEW others travel on, which mark the key as frequent for
    the reducer and connect it to other tasks' stars.
    """

    def __init__(self, buckets: int, limit: int = 2_000_000):
        self.buckets, self.limit = buckets, limit
        self.parts: list[np.ndarray] = []
        self.waiting = 0

    def add(self, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(part)
        self.waiting += len(part)
        if self.waiting >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.waiting:
            return
        held, first, size = _grouped(np.concatenate(self.parts))
        self.parts, self.waiting = [], 0
        stars = _distinct(_stars(held, first, size))
        nth = np.arange(len(held)) - np.repeat(first, size)
        rest = held[nth <= FEW]
        shift = np.uint64(64 - (self.buckets - 1).bit_length())
        cut = np.searchsorted(rest["key"] >> shift, np.arange(self.buckets + 1).astype(np.uint64))
        of_star = np.arange(len(stars)) % self.buckets
        rows = [(b, rest[x:y].tobytes(), stars[of_star == b].tobytes() if len(stars) else b"")
                for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist()))]
        rows = [r for r in rows if r[1] or r[2]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
             pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "entries", "stars"])


def edges(packed: DataFrame, kind: np.dtype, may_pair: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Distinct candidate edges (a, b, star) from the rows of ``Packer``; edges of stars only say that nodes are connected.

    ``may_pair(x, y)`` says for aligned entries of one key, both from a key with few holders, whether they can be a pair.
    """
    def within(table):
        held, first, size = _grouped(np.frombuffer(b"".join(table["entries"].to_pylist()), kind))
        sent = np.frombuffer(b"".join(table["stars"].to_pylist()), np.int64).reshape(-1, 2)
        stars = _distinct(np.concatenate((_stars(held, first, size), sent)))
        pairs = [np.zeros((0, 2), np.int64)]
        few = np.flatnonzero((size > 1) & (size <= FEW))
        for step in range(1, FEW):
            run = few[size[few] > step]
            if len(run) == 0:
                break
            reps = size[run] - step
            at = np.repeat(first[run], reps) + np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
            x, y = held[at], held[at + step]
            ok = slice(None) if may_pair is None else may_pair(x, y)
            pairs.append(np.stack((x["node"][ok], y["node"][ok]), 1))
        listed = _distinct(np.concatenate(pairs))
        both = np.concatenate((listed, stars))
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1]),
                         "star": pa.array(np.arange(len(both)) >= len(listed))})

    return packed.groupBy("bucket").applyInArrow(within, EDGES).distinct()


def blocks(edge_table: DataFrame, weights: DataFrame, ws: Workspace, block_weight: int) -> DataFrame:
    """(node, family, block, other): each node once for every pair of blocks that its block takes part in.

    ``weights`` is (node, weight), one row per node; a family of total weight above ``block_weight`` is dealt by hash into
    blocks of about that weight, and every pair of blocks is a task of its own.
    """
    family = ws.table(components(edge_table, ws).withColumnRenamed("root", "family"), "families")
    sized = ws.table(family.join(weights, "node"), "weighed")
    count = sized.groupBy("family").agg(F.ceil(F.sum("weight") / block_weight).cast("int").alias("blocks"))
    dealt = sized.join(count, "family").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    one = dealt.where("blocks <= 1").select("node", "family", F.lit(0).alias("block"), F.lit(0).alias("other"))
    more = (dealt.where("blocks > 1")
            .select("node", "family", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to")).where("to <> mine")
            .select("node", "family", F.least("mine", "to").alias("block"), F.greatest("mine", "to").alias("other")))
    return one.union(more)


def in_blocks(rows: DataFrame, join: Callable[[list[int], list[bytes]], list[tuple[int, int]]]) -> DataFrame:
    """Distinct links (a, b) that ``join(nodes, contents)`` finds in every (family, block, other) group of
    ``rows`` (family, block, other, node, content).

    Rows stream through sorted tasks, one group in memory at a time.
    """
    ordered = rows.repartition("family", "block", "other").sortWithinPartitions("family", "block", "other", "node")

    def run(batches):
        now, nodes, contents = None, [], []
        a, b = [], []

        def close():
            if len(nodes) > 1:
                for x, y in join(nodes, contents):
                    a.append(min(x, y))
                    b.append(max(x, y))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            content = batch.column(4)
            for i, (family, block, other, node) in enumerate(zip(*columns)):
                if (family, block, other) != now:
                    close()
                    now, nodes, contents = (family, block, other), [], []
                if not nodes or nodes[-1] != node:          # a node stands once in a group
                    nodes.append(node)
                    contents.append(content[i].as_py())
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return ordered.select("family", "block", "other", "node", "content").mapInArrow(run, "a long, b long").distinct()


def fixed_table(pieces: DataFrame, size: int) -> np.ndarray:
    """The pieces (at bigint, bytes binary) of a byte array of a fixed size, put together on the driver."""
    out = np.zeros(size, np.uint8)
    for at, raw in zip(*(c.to_pylist() for c in pieces.select("at", "bytes").toArrow().columns)):
        out[at:at + len(raw)] = np.frombuffer(raw, np.uint8)
    return out
