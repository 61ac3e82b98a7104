"""Alerts from rule candidates and cycle hits, de-duplicated by key.

The first alert event of a ``deduplication_key`` in arrival order is canonical
and is never replaced; evidence (accounts, transactions) is the union over all
accepted events of the key.  Events that the table refuses (a null in a column, or a
key, rule type or status that is too long) are rejected whole -- before the
split into the three outputs -- so an alert never exists without its evidence
or vice versa (A9).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch.sources.intake import dead_letters

OPEN = "OPEN"
MAX_KEY_LENGTH = 255
MAX_RULE_LENGTH, MAX_STATUS_LENGTH = 50, 20

ALERT_EVENT = ["alert_id", "deduplication_key", "rule_type", "primary_account_id", "status",
               "involved_accounts", "transaction_ids", "generated_at", "trigger_event_id"]
ALERT_ROW = ["alert_id", "deduplication_key", "rule_type", "primary_account_id", "status", "created_at"]


def from_candidates(cands: DataFrame) -> DataFrame:
    """A1: candidate -> alert event, ``alert_id = candidate_id``, status OPEN."""
    return cands.select(F.col("candidate_id").alias("alert_id"), "deduplication_key", "rule_type",
                        "primary_account_id", F.lit(OPEN).alias("status"), "involved_accounts",
                        "transaction_ids", "generated_at", "trigger_event_id")


def union(*frames: DataFrame) -> DataFrame:
    """Merge alert events of several producers."""
    return reduce(lambda a, b: a.unionByName(b), [f.select(*ALERT_EVENT) for f in frames])


def _acceptable() -> Column:
    needed = [F.col(c).isNotNull() for c in ("alert_id", "deduplication_key", "rule_type", "primary_account_id",
                                             "status", "generated_at")]
    fits = [F.length("deduplication_key") <= MAX_KEY_LENGTH, F.length("rule_type") <= MAX_RULE_LENGTH,
            F.length("status") <= MAX_STATUS_LENGTH]
    return reduce(Column.__and__, needed + fits)


def accepted(events: DataFrame) -> DataFrame:
    return events.where(_acceptable())


def rejected(events: DataFrame) -> DataFrame:
    """Alert events refused whole (go to the dead-letter table)."""
    return events.where(~F.coalesce(_acceptable(), F.lit(False)))


REJECTED = "alert rejected: missing rule/primary or key too long"


def dead(events: DataFrame) -> DataFrame:
    """S3: refused alert events as dead letters."""
    return dead_letters(rejected(events), "alerts", "fraud.alerts", F.col("deduplication_key"),
                        F.to_json(F.struct(*ALERT_EVENT)), F.lit(REJECTED), F.col("generated_at"))


def canonical(events: DataFrame) -> DataFrame:
    """A2: ``alerts`` table -- first accepted event per key, by arrival.

    Arrival of an alert event is ``(generated_at, trigger_event_id, alert_id)``.
    ``min_by`` is an ordinary aggregate, so a hot key is reduced map-side.
    """
    ok = accepted(events)
    order = F.struct("generated_at", "trigger_event_id", "alert_id")
    first = F.min_by(F.struct("alert_id", "rule_type", "primary_account_id", "status", "generated_at"), order)
    return (ok.groupBy("deduplication_key").agg(first.alias("c"))
            .select(F.col("c.alert_id").alias("alert_id"), "deduplication_key",
                    F.col("c.rule_type").alias("rule_type"),
                    F.col("c.primary_account_id").alias("primary_account_id"),
                    F.col("c.status").alias("status"), F.col("c.generated_at").alias("created_at")))


def _evidence(events: DataFrame, alerts: DataFrame, array_col: str, out: str) -> DataFrame:
    pairs = (accepted(events).select("deduplication_key", F.explode(array_col).alias(out))
             .where(F.col(out).isNotNull()).distinct())
    return pairs.join(alerts.select("deduplication_key", "alert_id"), "deduplication_key").select("alert_id", out)


def alert_accounts(events: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """A3: distinct ``(canonical alert_id, account_id)`` over all events of a key."""
    return _evidence(events, alerts if alerts is not None else canonical(events), "involved_accounts", "account_id")


def alert_transactions(events: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """A4: distinct ``(canonical alert_id, transaction_id)``."""
    return _evidence(events, alerts if alerts is not None else canonical(events), "transaction_ids",
                     "transaction_id")


def dedup_stats(events: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """A5: per rule, events that carried the canonical id vs. later duplicates."""
    alerts = alerts if alerts is not None else canonical(events)
    joined = accepted(events).join(
        alerts.select("deduplication_key", F.col("alert_id").alias("_canon")), "deduplication_key")
    same = F.col("alert_id") == F.col("_canon")
    return joined.groupBy("rule_type").agg(F.count_if(same).alias("created"),
                                           F.count_if(~same).alias("duplicates"))


def evidence_counts(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Accounts and transactions per alert."""
    a = accounts.groupBy("alert_id").agg(F.count(F.lit(1)).alias("account_count"))
    t = transactions.groupBy("alert_id").agg(F.count(F.lit(1)).alias("transaction_count"))
    return (a.join(t, "alert_id", "full")
            .select("alert_id", F.coalesce("account_count", F.lit(0)).alias("account_count"),
                    F.coalesce("transaction_count", F.lit(0)).alias("transaction_count")))


def by_rule(alerts: DataFrame, rule_type: str) -> DataFrame:
    """Alerts of one rule with key, time and primary account."""
    return (alerts.where(F.col("rule_type") == rule_type)
            .select("alert_id", "deduplication_key", "primary_account_id", "created_at"))
