"""Operator 11: centroid clustering (Lloyd's rounds in whole numbers) over subvector dictionaries.

Vectors become whole-number rows and lie in chunks of bounded size.  A chunk cuts its dimensions into blocks and stores, per
block, the distinct subvectors once and a code per vector, without loss.  A round computes the exact squared distance of each
distinct subvector to the centroids' parts once; a vector's distance is the sum of its codes' entries, and a cluster's sum
comes from counting codes.  The block width is chosen per chunk by counting that work: wide where many vectors share parts
(a vector that a third of the rows repeat costs one entry a chunk), narrow where values only repeat one by one.

Dictionaries belong to chunks, so neither a shuffle nor a broadcast grows with the rows: a round reads the chunks where they
are, and what leaves a task is one sum per cluster and dimension.  The driver sees k centroids.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; extra columns
are left out; every other row gets a result of its own, rows that repeat an id and rows with a null ``vec_id`` too.  Rows
with a null id are no starting centroids; ties of equal ids start in the order of their components.  With fewer usable
vectors than k there are fewer centroids; an empty table gives no rows.  A component beyond 2**27 in size after scaling
counts as that bound, which keeps every distance exact in 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

CHUNK = "n int, width int, ids array<long>, sizes array<int>, entries binary, codes binary"
LIMIT = 2 ** 27


@dataclass(frozen=True)
class ClusterConfig:
    k: int = 8
    rounds: int = 10
    dims: int = 64
    scale: int = 1024
    start: str = "3:"                # starts are the ids with the smallest sha256 of this and the id
    chunk_rows: int = 8192


def whole_numbers(rows: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(rows * float(scale)), -LIMIT, LIMIT).astype(np.int64)


def encode(rows: np.ndarray, k: int) -> tuple[int, list[np.ndarray], np.ndarray]:
    """(block width, distinct subvectors per block, codes as blocks x rows) with the least work of a round."""
    n, dims = rows.shape
    codes, entries = [], []
    for d in range(dims):
        values, code = np.unique(rows[:, d], return_inverse=True)
        entries.append(values[:, None])
        codes.append(code.reshape(-1))
    best, width = None, 1
    while True:
        work = sum(len(e) for e in entries) * width * k + n * len(entries) * k
        if best is None or work < best[0]:
            best = (work, width, entries, np.stack(codes))
        if len(entries) % 2:
            return best[1:]
        joined, pairs = [], []
        for left in range(0, len(entries), 2):             # two blocks of a width give one of twice the width
            held, code = np.unique(codes[left] * len(entries[left + 1]) + codes[left + 1], return_inverse=True)
            pairs.append(code.reshape(-1))
            joined.append(np.hstack([entries[left][held // len(entries[left + 1])], entries[left + 1][held % len(entries[left + 1])]]))
        entries, codes, width = joined, pairs, width * 2


class Chunk:
    """One stored chunk: its dictionaries and codes."""

    def __init__(self, width: int, sizes: list[int], entries: bytes, codes: bytes, n: int):
        parts = np.frombuffer(entries, np.int32).astype(np.int64).reshape(-1, width)
        self.entries = np.split(parts, np.cumsum(sizes)[:-1])
        self.codes = np.frombuffer(codes, np.uint16).reshape(len(sizes), n)
        self.width = width

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distances, vectors x centroids."""
        total = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        for b, (entries, codes) in enumerate(zip(self.entries, self.codes)):
            off = entries[:, None, :] - centroids[None, :, b * self.width:(b + 1) * self.width]
            total += (off * off).sum(-1)[codes]
        return total

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Componentwise sums of the clusters, k x dimensions."""
        parts = []
        for entries, codes in zip(self.entries, self.codes):
            count = np.bincount(codes.astype(np.int64) * k + cluster, minlength=len(entries) * k).reshape(-1, k)
            parts.append(count.T @ entries)
        return np.hstack(parts)


def usable(vectors: DataFrame, vec_id: str, vector: str, dims: int) -> DataFrame:
    """(vec_id, vector as array<double>) of the rows that take part."""
    x = F.col("vector")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
            .where(x.isNotNull() & (F.size(x) == dims) & fine))


def _encoded(vectors: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """The chunks of all vectors; a task fills each but its last."""
    limit = min(cfg.chunk_rows, 2 ** 16)                   # codes are 16 bits wide

    def chunk(table: pa.Table) -> pa.RecordBatch:
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        width, entries, codes = encode(whole_numbers(flat.reshape(-1, cfg.dims), cfg.scale), cfg.k)
        return pa.RecordBatch.from_pydict({
            "n": pa.array([table.num_rows], pa.int32()), "width": pa.array([width], pa.int32()),
            "ids": pa.array([table["vec_id"].to_pylist()], pa.list_(pa.int64())),
            "sizes": pa.array([[len(e) for e in entries]], pa.list_(pa.int32())),
            "entries": pa.array([np.vstack(entries).astype(np.int32).tobytes()], pa.binary()),
            "codes": pa.array([codes.astype(np.uint16).tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= limit:
                table = pa.Table.from_batches(held)
                yield chunk(table.slice(0, limit))
                held, rows = table.slice(limit).to_batches(), rows - limit
        if rows:
            yield chunk(pa.Table.from_batches(held))

    return vectors.mapInArrow(run, CHUNK)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, list]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Chunk(row["width"], row["sizes"], row["entries"], row["codes"], row["n"]), row.get("ids")


def _start(vectors: DataFrame, cfg: ClusterConfig) -> np.ndarray:
    """The k vectors with the smallest digests; k rows reach the driver."""
    named = vectors.where(F.col("vec_id").isNotNull()).select(
        F.sha2(F.concat(F.lit(cfg.start), F.col("vec_id").cast("string")), 256).alias("draw"), "vector")
    rows = named.orderBy("draw", "vector").limit(cfg.k).collect()
    return whole_numbers(np.array([r.vector for r in rows], np.float64).reshape(-1, cfg.dims), cfg.scale)


def _moved(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floor of each cluster's mean; a cluster without vectors keeps its centroid."""
    k, dims = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for chunk, _ in _chunks(batches):
            cluster = chunk.distances(centroids).argmin(1)             # the first of equal distances
            sums += chunk.sums(cluster, k)
            counts += np.bincount(cluster, minlength=k)
        for c in np.flatnonzero(counts):
            yield pa.RecordBatch.from_pydict({"cluster": pa.array([c] * (dims + 1), pa.int32()),
                                              "d": pa.array(range(dims + 1), pa.int32()),
                                              "part": pa.array([*sums[c].tolist(), int(counts[c])], pa.int64())})

    parts = chunks.select("n", "width", "sizes", "entries", "codes").mapInArrow(run, "cluster int, d int, part long")
    whole = {(r.cluster, r.d): int(r.whole) for r in
             parts.groupBy("cluster", "d").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("whole")).collect()}
    return np.array([[whole[c, d] // whole[c, dims] if (c, dims) in whole else int(centroids[c, d]) for d in range(dims)]
                     for c in range(k)], np.int64)


def cluster(vectors: DataFrame, cfg: ClusterConfig = ClusterConfig(), vec_id: str = "vec_id",
            vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every usable vector, final centroids)."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "centroids")
    kept = usable(vectors, vec_id, vector, cfg.dims)
    chunks = ws.table(_encoded(kept, cfg), "chunks")
    centroids = _start(kept, cfg)
    if len(centroids) == 0:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(cfg.rounds):
        centroids = _moved(chunks, centroids)

    def assigned(batches):
        for chunk, ids in _chunks(batches):
            off = chunk.distances(centroids)
            near = off.argmin(1)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "cluster": pa.array(near, pa.int32()),
                                              "distance": pa.array(off[np.arange(len(near)), near], pa.int64())})

    return ws.table(chunks.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "assigned"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256; the side that is broadcast has one row per centroid."""
    digest = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    names = assigned.sparkSession.createDataFrame(digest, "cluster int, centroid_sha256 string")
    each = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    per = each.join(F.broadcast(names), "cluster").select(            # one row per centroid
        "cluster", F.col("part").cast("long").alias("cluster_inertia"),
        F.sum("part").over(Window.partitionBy()).cast("long").alias("inertia"), "centroid_sha256")
    return assigned.join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
