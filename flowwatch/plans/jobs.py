"""Composed jobs: the flows of the system, each one lazy DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.config import DEFAULT_CYCLE, DEFAULT_RULES, CycleConfig
from flowwatch.operators import alerts, cycles, ledger, normalise, rules
from flowwatch.operators.activity import graph_update_failures, packed_events
from flowwatch.session import kept, release
from flowwatch.sources.intake import dead_letters


def rule_alerts(valid: DataFrame, rule_cfgs=DEFAULT_RULES) -> DataFrame:
    """Validated events -> rule candidates -> alert events (A1)."""
    return alerts.from_candidates(rules.candidates(valid, rule_cfgs))


def cycle_alerts(valid: DataFrame, cycle_cfg: CycleConfig = DEFAULT_CYCLE) -> DataFrame:
    """Validated events -> as-of cycle paths -> alert events."""
    return cycles.circular_alerts(cycles.circular_flow(valid, cycle_cfg))


def all_alert_events(valid: DataFrame, rule_cfgs=DEFAULT_RULES,
                     cycle_cfg: CycleConfig = DEFAULT_CYCLE) -> DataFrame:
    """Both producers into one alert event stream; the events are validated and packed once for both."""
    packed, uuids = packed_events(valid)
    events = kept(packed, "events")
    found = alerts.union(alerts.from_candidates(rules.candidates(events, rule_cfgs, packed=True)),
                         cycles.circular_alerts(cycles.circular_flow(events, cycle_cfg, packed=uuids)))
    release(events)                                          # both read only what they have written themselves from here on
    return found


def dead_letter_table(raw: DataFrame, decoded: DataFrame | None = None,
                      alert_events: DataFrame | None = None) -> DataFrame:
    """S3: every quarantined record with origin, topic, key, value and error."""
    valid = normalise.validated(raw)
    parts = []
    if decoded is not None:
        bad = decoded.where(F.col("decode_error").isNotNull())
        parts.append(dead_letters(bad, "normalisation", "transactions.raw", F.col("key"), F.col("value"),
                                  F.col("decode_error"), F.col("received_at")))
    conf = ledger.conflicts(valid)
    parts.append(dead_letters(conf, "ledger", "transactions.validated", F.col("transaction_id"),
                              F.to_json(F.struct(*ledger.LEDGER_COLUMNS)), F.col("error"), F.col("ingested_at")))
    rej = ledger.constraint_rejects(valid)
    parts.append(dead_letters(rej, "ledger", "transactions.validated", F.col("transaction_id"),
                              F.to_json(F.struct(*ledger.LEDGER_COLUMNS)), F.col("error"), F.col("ingested_at")))
    bad_graph = graph_update_failures(valid)
    parts.append(dead_letters(bad_graph, "graph", "graph.updates", F.col("source_account_id"),
                              F.to_json(F.struct(*bad_graph.columns)),
                              F.lit("correlation_id is not a UUID"), F.col("ingested_at")))
    if alert_events is not None:
        parts.append(alerts.dead(alert_events))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
