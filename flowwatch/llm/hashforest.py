"""Operator 10: approximate nearest neighbours by cosine with a hash-prefix forest.

Every tree has its own sequence of random hyperplanes; a vector's hash string is the sequence of sides it lies on, most
significant plane first, and a tree is the sorted array of the strings.  A query descends in every tree to
its longest matching prefix, then all trees ascend together, one prefix bit at a time, until the union of their matching
ranges holds enough candidates, which are compared in double precision.

Index rows lie in blocks of bounded size, queries in chunks; every chunk meets every block once, each pair in a task of its
own.  Equal vectors are one index entry with its smallest ids (k + 1 of them are all that a result can need), so a
vector that a third of the rows share costs one entry.  The planes are random; nothing is fitted, every row is indexed.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, as query or as
candidate; rows with a null vec_id neither; rows that repeat id and vector are one; a query is never its own candidate;
vectors of different lengths are not compared; ties go to the smaller vec_id; with fewer candidates than k all are
returned; other columns are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 48
    bits: int = 32
    share: float = 0.5               # of a block's entries, counted over all trees, that a query looks up at least
    least: int = 4096                # and so many at least, counted over all trees
    block_rows: int = 8192
    chunk_queries: int = 2048
    seed: int = 3


class Forest:
    """Sorted hash strings of one block of unit vectors."""

    def __init__(self, unit: np.ndarray, cfg: ForestConfig):
        self.cfg, self.unit = cfg, unit
        rng = np.random.default_rng(cfg.seed)
        self.planes = rng.normal(size=(cfg.trees, unit.shape[1], cfg.bits)).astype(np.float32)
        self.center = unit.mean(0).astype(np.float32)
        self.rows, self.keys = [], []
        for t in range(cfg.trees):
            key = self._strings(unit, t)
            order = np.argsort(key, kind="stable")
            self.rows.append(order)
            self.keys.append(key[order])

    def _strings(self, unit: np.ndarray, tree: int) -> np.ndarray:
        side = (unit.astype(np.float32) - self.center) @ self.planes[tree] > 0
        return side @ (np.uint64(1) << np.arange(self.cfg.bits - 1, -1, -1, dtype=np.uint64))

    def candidates(self, queries: np.ndarray) -> list[np.ndarray]:
        """Per query the entries that share its prefixes, from the longest down to the first length with enough of them."""
        cfg, n = self.cfg, len(self.unit)
        want = min(cfg.trees * n, max(cfg.least, int(cfg.share * n)))      # ranges of several trees may overlap
        strings = [self._strings(queries, t) for t in range(cfg.trees)]
        level = np.full(len(queries), -1)
        low = np.zeros((cfg.trees, len(queries)), np.int64)
        high = np.full((cfg.trees, len(queries)), n)
        for depth in range(cfg.bits, -1, -1):                 # synchronous ascent
            open_ = np.flatnonzero(level < 0)
            if len(open_) == 0:
                break
            free = np.uint64((1 << (cfg.bits - depth)) - 1)
            for t in range(cfg.trees):
                first = strings[t][open_] & ~free
                low[t, open_] = np.searchsorted(self.keys[t], first, "left")
                high[t, open_] = np.searchsorted(self.keys[t], first | free, "right")
            held = (high[:, open_] - low[:, open_]).sum(0)
            level[open_[held >= want]] = depth
        return [np.unique(np.concatenate([self.rows[t][low[t, q]:high[t, q]] for t in range(cfg.trees)]))
                for q in range(len(queries))]


def _unit(rows: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    if len(rows) == 0:
        return np.zeros((0, 0))
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _search(entries: pa.Table, queries: pa.Table, k: int, cfg: ForestConfig) -> tuple[list, list, list]:
    ids = entries["ids"].to_pylist()
    e, q = _unit(entries["vector"]), _unit(queries["vector"])
    e_norm, q_norm = np.sqrt((e * e).sum(1)), np.sqrt((q * q).sum(1))
    qid = queries["query_id"].to_pylist()
    forest = Forest(e / e_norm[:, None], cfg)
    out_q, out_v, out_s = [], [], []
    for i, found in enumerate(forest.candidates(q / q_norm[:, None])):
        score = (e[found] @ q[i]) / (e_norm[found] * q_norm[i])
        if len(found) > k + 1:
            cut = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            near = np.flatnonzero(score >= cut)                # ties at the cut stay in
        else:
            near = np.arange(len(found))
        best = sorted(((-score[j], v) for j in near for v in ids[found[j]] if v != qid[i]))[:k]
        out_q += [qid[i]] * len(best)
        out_v += [v for _, v in best]
        out_s += [-s for s, _ in best]
    return out_q, out_v, out_s


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector as array<double>) of the rows that take part, each once."""
    x = F.col("vector")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(x, lambda c: c != 0)
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
            .where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).distinct())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, cfg: ForestConfig = ForestConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest rows of ``vectors``.

    Both have the columns of ``usable``.
    """
    ws = Workspace(vectors.sparkSession, "forest")
    smallest = Window.partitionBy("vector").orderBy("vec_id")      # ranked on the map side before the shuffle
    entries = ws.table(vectors.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
                       .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    asked = ws.table(queries.select(F.col("vec_id").alias("query_id"), "vector"), "queries")
    blocks = max(1, -(-entries.count() // cfg.block_rows))
    chunks = max(1, -(-asked.count() // cfg.chunk_queries))
    left = entries.select(F.size("vector").alias("dims"), F.pmod(F.xxhash64("vector"), F.lit(blocks)).alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "ids", "vector")
    right = asked.select(F.size("vector").alias("dims"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                         F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk"), "query_id", "vector")

    def search(entry, query):
        q, v, s = _search(entry, query, k, cfg) if entry.num_rows and query.num_rows else ([], [], [])
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    key = ["dims", "block", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
