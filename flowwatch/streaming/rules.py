"""The first-crossing rule on a stream, without Python.

``groupBy(window, key, currency)`` keeps the arrivals of a group (evidence needs them until the rule fires, as in the
reference's window store).  Whether a group has the accounts and arrivals it needs is read without an order.  Only the arrivals of one
that has are sorted, by ``(ingested_at, event_id)``, and the first that meets the thresholds is looked up (under an amount threshold,
by a fold with ``aggregate()``); a group that has met them is sent again
unchanged by later rows, and the sink's first-wins key (S6) makes it one candidate.  The watermark
on ``occurred_at`` lags by the grace; Spark drops rows whose window has closed and the state of closed windows.

Stream == batch holds when rows reach the stream in arrival order and none is late (tested).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch.config import RuleConfig
from flowwatch.operators.activity import activity
from flowwatch.operators.rules import CANDIDATE_OUT, identity

_FOLD = "struct<accounts:array<string>,n:bigint,amount:bigint,hit:boolean>"


def _folded_place(arrivals: Column, cfg: RuleConfig) -> Column:
    """``_place`` under an amount threshold: a fold up to the first arrival that meets all thresholds."""
    start = F.struct(F.array().cast("array<string>").alias("accounts"), F.lit(0).cast("bigint").alias("n"),
                     F.lit(0).cast("bigint").alias("amount"), F.lit(False).alias("hit"))

    def step(held: Column, row: Column) -> Column:
        accounts = F.array_union(held["accounts"], F.array(row["counterparty"]))
        n, amount = held["n"] + 1, held["amount"] + row["amount_minor"]
        meets = (F.size(accounts) >= cfg.min_distinct) & (n >= cfg.min_count) & (amount >= cfg.min_amount)
        moved = F.struct(accounts.alias("accounts"), n.alias("n"), amount.alias("amount"), meets.alias("hit"))
        return F.when(held["hit"], held).otherwise(moved).cast(_FOLD)

    return F.aggregate(arrivals, start.cast(_FOLD), step, lambda held: F.when(held["hit"], held["n"]))


def _reached(arrivals: Column, cfg: RuleConfig) -> Column:
    """Whether a group has the accounts and arrivals it needs, in whatever order they lie."""
    return ((F.size(F.array_distinct(arrivals["counterparty"])) >= cfg.min_distinct)
            & (F.size(arrivals) >= cfg.min_count))


def _place(arrivals: Column, cfg: RuleConfig) -> Column:
    """Place, from 1, of the first of the sorted arrivals of a group, ``_reached``, that meets the thresholds; null if none does."""
    if cfg.min_amount > 0:
        return _folded_place(arrivals, cfg)
    accounts = arrivals["counterparty"]
    last = F.get(F.array_distinct(accounts), F.lit(cfg.min_distinct - 1))
    return F.greatest(F.array_position(accounts, last), F.lit(cfg.min_count).cast("bigint"))


def stream_candidates(events: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Fraud candidates of one rule from a stream of validated events (update mode).

    ``events`` must carry TIMESTAMP (not TIMESTAMP_NTZ) ``occurred_at`` and
    ``ingested_at``; the output has the candidate columns of the batch operator.
    """
    row = F.struct(F.struct(F.col("ingested_at").alias("ts"), F.col("event_id").alias("id")).alias("arr"),
                   "counterparty", "transaction_id", "amount_minor")
    groups = (activity(events, (cfg,))
              .withWatermark("occurred_at", f"{cfg.grace_seconds} seconds")
              .groupBy(F.window("occurred_at", f"{cfg.window_seconds} seconds").alias("w"), "rule_type", "key", "currency")
              .agg(F.collect_list(row).alias("arrivals")))
    found = (groups.where(_reached(F.col("arrivals"), cfg))
             .withColumn("arrivals", F.sort_array("arrivals"))
             .withColumn("n", _place(F.col("arrivals"), cfg)))
    if cfg.min_amount > 0:
        found = found.where(F.col("n").isNotNull())
    found = found.withColumns({"upto": F.slice("arrivals", F.lit(1), F.col("n").cast("int")),
                               "hit": F.get("arrivals", F.col("n").cast("int") - 1)["arr"]})
    seen = F.filter("arrivals", lambda r: r["arr"] <= F.col("hit"))           # with repeated deliveries of the crossing event
    accounts = F.array_distinct(F.col("upto")["counterparty"])
    flat = found.select(
        "rule_type", "key", "currency", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        F.size(accounts).alias("distinct_accounts_count"), F.col("n").alias("transaction_count"),
        F.aggregate(F.col("upto")["amount_minor"], F.lit(0).cast("bigint"), lambda total, amount: total + amount).alias("total_amount_minor"),
        F.sort_array(accounts).alias("involved_accounts"),
        F.sort_array(F.array_distinct(seen["transaction_id"])).alias("transaction_ids"),
        F.col("hit.ts").alias("generated_at"), F.col("hit.id").alias("trigger_event_id"))
    return identity(flat, (cfg,)).select(*CANDIDATE_OUT)


def start_rule_streams(events: DataFrame, rules, checkpoint_root: str, sink_for, trigger: dict | None = None):
    """Start one streaming query per rule over the same source.

    Update mode allows one aggregation per query, so the four rules
    run as four queries (as the reference runs four topologies); each gets its
    own checkpoint and a ``foreachBatch`` sink from ``sink_for(rule_config)``
    -- typically an :class:`~flowwatch.streaming.sinks.IdempotentSink` keyed on
    ``deduplication_key``.
    """
    queries = []
    for cfg in rules:
        writer = (stream_candidates(events, cfg).writeStream.outputMode("update").foreachBatch(sink_for(cfg))
                  .option("checkpointLocation", os.path.join(checkpoint_root, cfg.rule_type.lower()))
                  .queryName(f"rule_{cfg.rule_type.lower()}"))
        if trigger:
            writer = writer.trigger(**trigger)
        queries.append(writer.start())
    return queries
