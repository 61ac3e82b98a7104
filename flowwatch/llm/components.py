"""Connected components of an edge table, by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

MAX_ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every neighbour on the smallest node it can see.

    Minima are aggregates with map-side partials; the join back to the neighbours is a
    plain equi-join, which adaptive execution splits where a hub holds many edges.
    """
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    out = near.join(low, "a")
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root): every node of an (a, b) bigint edge table with the smallest node it reaches.

    Nodes without an edge to another node do not appear.  The loop ends when a round
    leaves the edges unchanged (count and checksum); each round's edges are a written table.
    """
    now = ws.table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        now = ws.table(_star(_star(now, large=True), large=False), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
