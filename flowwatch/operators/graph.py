"""The account / device / IP graph as node and edge tables.

Edges ``(src, dst, currency)`` aggregate every distinct event id once.  All
edge attributes are associative aggregates (min, max, count, sum and an
arg-min for the latest transaction), so the final graph is one partial
aggregation and incremental maintenance (G8) can merge batch deltas.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.functions import arrival, epoch_micros, not_empty
from flowwatch.schemas import EVENT_COLUMNS

EDGE_KEY = ["src", "dst", "currency"]
EDGE_COLUMNS = ["src", "dst", "currency", "first_seen", "last_seen", "transaction_count",
                "total_amount_minor", "latest_transaction_id", "latest_occurred_at"]


#: What edges and their versions read of an event.
EDGE_EVENT = ["event_id", "transaction_id", "source_account_id", "destination_account_id", "amount_minor", "currency",
              "occurred_at", "ingested_at"]


def processed(updates: DataFrame, columns: list[str] = EVENT_COLUMNS) -> DataFrame:
    """G1: each event id applied once -- its first arrival, with these of its columns."""
    return (updates.groupBy("event_id")
            .agg(F.min_by(F.struct(*columns), arrival()).alias("e"))
            .select("e.*"))


def accounts(events: DataFrame) -> DataFrame:
    """Distinct accounts on either side of a transfer."""
    return (events.select(F.explode(F.array("source_account_id", "destination_account_id"))
                          .alias("account_id")).distinct())


def _latest_order() -> Column:
    # Latest = greatest occurred_at; on equal times the earlier arrival stays.
    return F.struct((-epoch_micros(F.col("occurred_at"))).alias("neg_occ"), arrival().alias("arr"))


def _edge_rows(events: DataFrame) -> DataFrame:
    return events.select(F.col("source_account_id").alias("src"),
                         F.col("destination_account_id").alias("dst"), "currency", "occurred_at",
                         "amount_minor", "transaction_id", "ingested_at", "event_id")


def edges(events: DataFrame) -> DataFrame:
    """One row per ``(src, dst, currency)`` over distinct event ids."""
    latest = F.min_by(F.struct("transaction_id", "occurred_at"), _latest_order())
    return (_edge_rows(events).groupBy(*EDGE_KEY).agg(
        F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"),
        F.count(F.lit(1)).alias("transaction_count"), F.sum("amount_minor").alias("total_amount_minor"),
        latest.alias("l"))
        .select(*EDGE_KEY[:3], "first_seen", "last_seen", "transaction_count", "total_amount_minor",
                F.col("l.transaction_id").alias("latest_transaction_id"),
                F.col("l.occurred_at").alias("latest_occurred_at")))


def used_device(events: DataFrame) -> DataFrame:
    """Distinct ``(account, device)``; any non-empty id makes a node."""
    return (events.where(not_empty(F.col("device_id")))
            .select(F.col("source_account_id").alias("account_id"), "device_id").distinct())


def used_ip(events: DataFrame) -> DataFrame:
    """Distinct ``(account, ip_hash)``."""
    return (events.where(not_empty(F.col("ip_hash")))
            .select(F.col("source_account_id").alias("account_id"), "ip_hash").distinct())


def edge_report(edge_df: DataFrame) -> DataFrame:
    """Edges with count and total."""
    return edge_df.select("src", "dst", "currency", "transaction_count", "total_amount_minor")


def _beginning(ts_type: str) -> Column:
    """An arrival before all others."""
    return F.struct(F.lit("0001-01-01 00:00:00").cast(ts_type).alias("ts"), F.lit("").alias("id"))


def edge_versions(events: DataFrame, bucket_seconds: int = 3600, base: DataFrame | None = None,
                  keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """State of each edge after each of its events, valid between arrivals.

    ``base`` holds the edges (with ``latest`` as arg-min struct) that events before these have made: the versions go on from
    them, and each of them is a version that is valid until the first of these events on it.

    A version made by the event arriving at ``valid_from`` is what a reader
    arriving in ``(valid_from, valid_to]`` sees; ``valid_to`` is the next
    arrival on the same edge, null for the current version.

    Running aggregates are two-level so that one very busy edge is not one
    task: per ``(edge, arrival bucket)`` partial aggregates, a running merge
    over the bucket table (one row per edge and bucket), and running
    aggregates inside each bucket only.  All attributes are associative.

    ``keep`` may write the events and the running bucket table, so that their shuffles need no room beside the later ones.
    """
    width = bucket_seconds * 1_000_000
    events = keep(events)
    rows = (_edge_rows(events).withColumn("arr", arrival())
            .withColumn("_lo", F.struct(_latest_order().alias("o"), F.col("transaction_id"), F.col("occurred_at")))
            .withColumn("_b", F.floor(epoch_micros(F.col("ingested_at")) / width)))
    per_bucket = rows.groupBy(*EDGE_KEY, "_b").agg(
        F.min("occurred_at").alias("_bmin"), F.max("occurred_at").alias("_bmax"),
        F.count(F.lit(1)).alias("_bn"), F.sum("amount_minor").alias("_bs"),
        F.min("_lo").alias("_bl"), F.min("arr").alias("_bfirst"))
    if base is not None:
        per_bucket = per_bucket.unionByName(base.select(
            *EDGE_KEY, F.lit(-(1 << 62)).cast("long").alias("_b"), F.col("first_seen").alias("_bmin"), F.col("last_seen").alias("_bmax"),
            F.col("transaction_count").alias("_bn"), F.col("total_amount_minor").alias("_bs"),
            F.struct(F.col("latest.o").alias("o"), F.col("latest.transaction_id").alias("transaction_id"),
                     F.col("latest.occurred_at").alias("occurred_at")).alias("_bl"),
            F.lit(None).cast(per_bucket.schema["_bfirst"].dataType).alias("_bfirst")))
    before = Window.partitionBy(*EDGE_KEY).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = Window.partitionBy(*EDGE_KEY).orderBy("_b")
    prior = keep(per_bucket.select(
        *EDGE_KEY, "_b",
        F.min("_bmin").over(before).alias("_pmin"), F.max("_bmax").over(before).alias("_pmax"),
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_pn"),
        F.coalesce(F.sum("_bs").over(before), F.lit(0)).alias("_ps"),
        F.min("_bl").over(before).alias("_pl"),
        F.lead("_bfirst").over(by_bucket).alias("_next_bucket_first")))
    upto = Window.partitionBy(*EDGE_KEY, "_b").orderBy("arr").rowsBetween(Window.unboundedPreceding, 0)
    nxt = Window.partitionBy(*EDGE_KEY, "_b").orderBy("arr")
    inside = rows.select(
        *EDGE_KEY, "_b", "arr",
        F.min("occurred_at").over(upto).alias("_rmin"), F.max("occurred_at").over(upto).alias("_rmax"),
        F.count(F.lit(1)).over(upto).alias("_rn"), F.sum("amount_minor").over(upto).alias("_rs"),
        F.min("_lo").over(upto).alias("_rl"), F.lead("arr").over(nxt).alias("_next"))
    latest = F.least("_pl", "_rl")
    made = (inside.join(prior, EDGE_KEY + ["_b"])
            .select(*EDGE_KEY,
                    F.least("_pmin", "_rmin").alias("first_seen"),
                    F.greatest("_pmax", "_rmax").alias("last_seen"),
                    (F.col("_pn") + F.col("_rn")).alias("transaction_count"),
                    (F.col("_ps") + F.col("_rs")).alias("total_amount_minor"),
                    latest["transaction_id"].alias("latest_transaction_id"),
                    latest["occurred_at"].alias("latest_occurred_at"),
                    F.col("arr").alias("valid_from"),
                    F.coalesce("_next", "_next_bucket_first").alias("valid_to")))
    if base is None:
        return made
    first = rows.groupBy(*EDGE_KEY).agg(F.min("arr").alias("valid_to"))
    ts_type = events.schema["ingested_at"].dataType.simpleString()
    kept = base.join(first, EDGE_KEY, "left").select(
        *EDGE_KEY, "first_seen", "last_seen", "transaction_count", "total_amount_minor",
        F.col("latest.transaction_id").alias("latest_transaction_id"), F.col("latest.occurred_at").alias("latest_occurred_at"),
        _beginning(ts_type).alias("valid_from"), "valid_to")
    return made.unionByName(kept)
