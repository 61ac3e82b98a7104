"""Query catalog: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each reads the driver's tables (``events`` through the fixture recipe)
and runs over all of their rows.  Set-valued
columns are returned as sorted, comma-joined strings and path-valued ones as
joined strings in path order, so results can be compared by value.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch import session
from flowwatch.config import DRIVER_CYCLE, DRIVER_RULES, rule
from flowwatch.functions import epoch_micros, sorted_join
from flowwatch.operators import activity as act
from flowwatch.operators import alerts, cycles, evaluation, graph, ledger, metrics, normalise, rules
from flowwatch.plans import jobs
from flowwatch.schemas import EVENT_COLUMNS
from flowwatch.sources import intake
from flowwatch.sources.staging import staged
from flowwatch.sources.tables import load_base_transactions, load_transactions

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _raw(spark, sf) -> DataFrame:
    session.prepare(spark)
    return load_transactions(spark, sf)


def _valid(spark, sf) -> DataFrame:
    return normalise.validated(_raw(spark, sf))


def _base(spark, sf) -> DataFrame:
    session.prepare(spark)
    return load_base_transactions(spark, sf)


def flat_candidates(c: DataFrame) -> DataFrame:
    return c.select(*[sorted_join(F.col(x)).alias(x) if x in ("involved_accounts", "transaction_ids")
                      else F.col(x) for x in rules.CANDIDATE_OUT])


def flat_alert_events(a: DataFrame) -> DataFrame:
    return a.select(*[sorted_join(F.col(x)).alias(x) if x in ("involved_accounts", "transaction_ids")
                      else F.col(x) for x in alerts.ALERT_EVENT])


def flat_paths(p: DataFrame) -> DataFrame:
    return p.select("cand_event_id", "cand_ingested_at", "cand_transaction_id", "primary_account_id", "depth",
                    F.array_join("path_accounts", ">").alias("path_accounts"),
                    F.array_join("path_transactions", ",").alias("path_transactions"),
                    F.array_join("path_currencies", ",").alias("path_currencies"))


# ---------------------------------------------------------------- sources
def requests(spark, sf) -> DataFrame:
    """Intake requests: the fixture transactions as clients would post them."""
    return _base(spark, sf).select(F.col("id").alias("request_id"), "transaction_id", "source_account_id",
                                   "destination_account_id", "amount_minor", "currency", "device_id", "ip_hash",
                                   "occurred_at", F.col("ingested_at").alias("received_at"))


@register("transaction_intake")
def q_transaction_intake(spark, sf):
    return intake.transaction_intake(requests(spark, sf)).select(
        "request_id", "status", "event_id", "transaction_id", "correlation_id", "ingested_at")


def _quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                    F.lit('"'))


def messages(spark, sf) -> DataFrame:
    """Wire messages built from the fixture rows, with decoding faults:
    truncated JSON, double-encoded JSON and epoch-second instants."""
    b = _base(spark, sf)
    epoch = (epoch_micros(F.col("occurred_at")).cast("decimal(30,9)") / 1_000_000).cast("decimal(30,6)")
    fields = [F.col(c) for c in EVENT_COLUMNS if c != "occurred_at"]
    occ = F.when(F.col("id") % 227 == 0, epoch.cast("string")).otherwise(None)
    iso_opts = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    as_iso = F.to_json(F.struct(*fields, F.col("occurred_at")), iso_opts)
    as_epoch = F.to_json(F.struct(*fields, epoch.cast("string").alias("occurred_at")), iso_opts)
    text = F.when(occ.isNotNull(), as_epoch).otherwise(as_iso)
    # fault injection: a cut-off payload (undecodable JSON) for every 211th row
    text = F.when(F.col("id") % 211 == 0, F.substring(text, 1, 25)).otherwise(text)
    text = F.when(F.col("id") % 223 == 0, _quote(text)).otherwise(text)
    text = F.when(F.col("id") % 229 == 0, F.lit("null")).otherwise(text)         # a null event
    return b.select("id", F.col("source_account_id").alias("key"), text.alias("value"),
                    F.col("ingested_at").alias("received_at"))


@register("json_decode")
def q_json_decode(spark, sf):
    d = intake.json_decode(messages(spark, sf))
    return d.select("id", "double_encoded", "decode_error", *EVENT_COLUMNS)


@register("dead_letter")
def q_dead_letter(spark, sf):
    decoded = intake.json_decode(messages(spark, sf))
    return jobs.dead_letter_table(_raw(spark, sf), decoded, _fixture_alert_events(spark, sf)).select(
        "origin", "topic", "key", "error", "event_time")


@register("event_time")
def q_event_time(spark, sf):
    return intake.event_time(_raw(spark, sf)).select("event_id", "ingested_at", "occurred_at", "event_time")


# ---------------------------------------------------------------- validation and re-keying
@register("normalise_valid")
def q_normalise_valid(spark, sf):
    return _valid(spark, sf)


@register("normalise_invalid")
def q_normalise_invalid(spark, sf):
    return normalise.invalid(_raw(spark, sf)).select("event.*", "failure_reason", "failed_at")


@register("normalise_counts")
def q_normalise_counts(spark, sf):
    return normalise.outcome_counts(_raw(spark, sf))


@register("activity_by_source")
def q_by_source(spark, sf):
    return act.by_source(_valid(spark, sf))


@register("activity_by_destination")
def q_by_destination(spark, sf):
    return act.by_destination(_valid(spark, sf))


@register("activity_by_device")
def q_by_device(spark, sf):
    return act.by_device(_valid(spark, sf))


@register("activity_by_ip")
def q_by_ip(spark, sf):
    return act.by_ip(_valid(spark, sf))


@register("activity_union")
def q_activity_union(spark, sf):
    return act.activity(_valid(spark, sf), DRIVER_RULES)


@register("graph_update")
def q_graph_update(spark, sf):
    return act.graph_updates(_valid(spark, sf))


# ---------------------------------------------------------------- windowed rules
def _rule_query(rule_type: str) -> Query:
    def q(spark, sf):
        cfg = (rule(DRIVER_RULES, rule_type),)
        return flat_candidates(rules.candidates(_valid(spark, sf), cfg))
    return q


for _key, _rt in (("fan_out", "FAN_OUT"), ("fan_in", "FAN_IN"), ("shared_device", "SHARED_DEVICE"),
                  ("shared_ip", "SHARED_IP")):
    REGISTRY[_key] = _rule_query(_rt)


@register("rule_first_crossing")
def q_first_crossing(spark, sf):
    return flat_candidates(rules.candidates(_valid(spark, sf), DRIVER_RULES))


@register("candidate_event_time")
def q_candidate_event_time(spark, sf):
    """S4 for the candidates' own topic."""
    return intake.event_time(rules.candidates(_valid(spark, sf), DRIVER_RULES)).select("deduplication_key", "generated_at", "event_time")


@register("rule_window_final")
def q_window_final(spark, sf):
    return rules.window_final(act.activity(_valid(spark, sf), DRIVER_RULES), DRIVER_RULES)


@register("candidate_identity")
def q_candidate_identity(spark, sf):
    fired = rules.window_final(act.activity(_valid(spark, sf), DRIVER_RULES), DRIVER_RULES)
    return rules.identity(fired, DRIVER_RULES).select(
        "rule_type", "key", "currency", "window_start", "deduplication_key", "candidate_id", "primary_account_id")


#: The stream's rules: a grace beyond the fixture's delays (replays and conflicts come hours late), so that no row is late.
STREAM_RULES = tuple(replace(r, grace_seconds=3 * 86400) for r in DRIVER_RULES)


@register("rule_streaming")
def q_rule_streaming(spark, sf):
    """The rules as streaming queries over the events in batches by arrival, read back from their sinks."""
    from flowwatch.streaming import flows
    valid = _valid(spark, sf)
    valid = valid.withColumns({c: F.col(c).cast("timestamp") for c in ("occurred_at", "ingested_at")})
    found = flows.replay_rules(valid, STREAM_RULES, f"{session.checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}")
    plain = found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end", "generated_at")})
    return flat_candidates(plain)


@register("late_events")
def q_late_events(spark, sf):
    return rules.late_events(act.activity(_valid(spark, sf), DRIVER_RULES), DRIVER_RULES)


@register("rule_evidence")
def q_rule_evidence(spark, sf):
    return rules.evidence(_valid(spark, sf), DRIVER_RULES)


# ---------------------------------------------------------------- alerts
def _fixture_alert_events(spark, sf) -> DataFrame:
    """The alert stream (A8) that all projector queries read: staged once per state of the input, like the transactions."""
    session.prepare(spark)
    return staged(spark, "alert_events", sf, lambda: jobs.all_alert_events(_valid(spark, sf), DRIVER_RULES, DRIVER_CYCLE))


@register("alert_generation")
def q_alert_generation(spark, sf):
    return flat_alert_events(jobs.rule_alerts(_valid(spark, sf), DRIVER_RULES))


@register("alert_union")
def q_alert_union(spark, sf):
    return flat_alert_events(_fixture_alert_events(spark, sf))


@register("alerts")
def q_alerts(spark, sf):
    return alerts.canonical(_fixture_alert_events(spark, sf))


@register("alert_accounts")
def q_alert_accounts(spark, sf):
    return alerts.alert_accounts(_fixture_alert_events(spark, sf))


@register("alert_transactions")
def q_alert_transactions(spark, sf):
    return alerts.alert_transactions(_fixture_alert_events(spark, sf))


@register("alert_dedup_stats")
def q_alert_dedup_stats(spark, sf):
    return alerts.dedup_stats(_fixture_alert_events(spark, sf))


@register("alert_evidence_counts")
def q_alert_evidence_counts(spark, sf):
    ev = _fixture_alert_events(spark, sf)
    canon = alerts.canonical(ev)
    return alerts.evidence_counts(alerts.alert_accounts(ev, canon), alerts.alert_transactions(ev, canon))


@register("alerts_by_rule")
def q_alerts_by_rule(spark, sf):
    return alerts.by_rule(alerts.canonical(_fixture_alert_events(spark, sf)), "SHARED_DEVICE")


# ---------------------------------------------------------------- ledger
@register("ledger")
def q_ledger(spark, sf):
    return ledger.ledger(_valid(spark, sf))


@register("ledger_conflicts")
def q_ledger_conflicts(spark, sf):
    return ledger.conflicts(_valid(spark, sf))


@register("ledger_replays")
def q_ledger_replays(spark, sf):
    return ledger.replays(_valid(spark, sf))


@register("ledger_constraints")
def q_ledger_constraints(spark, sf):
    return ledger.constraint_rejects(_valid(spark, sf))


# Lookup parameters: one source account (users pay inside blocks of ten, user 7
# exists at every scale) over the first fortnight of the data.
LOOKUP_ACCOUNT_NAME = "acct-7"
LOOKUP_START, LOOKUP_END = "2024-01-01 00:00:00", "2024-01-15 00:00:00"


def _ledger_index(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The ledger's lookup copies and their ranges, staged once per state of the input."""
    index = staged(spark, "ledger_index", sf, lambda: ledger.index_rows(ledger.ledger(_valid(spark, sf))),
                   partition_by=ledger.INDEX_PARTS)
    return index, staged(spark, "ledger_index_ranges", sf, lambda: ledger.index_ranges(index))


@register("ledger_lookup")
def q_ledger_lookup(spark, sf):
    from flowwatch.functions import name_uuid
    key = name_uuid(F.lit(LOOKUP_ACCOUNT_NAME))   # constant-folded by Catalyst
    index, ranges = _ledger_index(spark, sf)
    return ledger.lookup_index(index, ranges, "source", key, F.lit(LOOKUP_START).cast("timestamp_ntz"),
                               F.lit(LOOKUP_END).cast("timestamp_ntz"))


# ---------------------------------------------------------------- graph
def _updates(spark, sf) -> DataFrame:
    return graph.processed(act.graph_updates(_valid(spark, sf)))


@register("graph_processed")
def q_graph_processed(spark, sf):
    return _updates(spark, sf)


@register("graph_accounts")
def q_graph_accounts(spark, sf):
    return graph.accounts(_updates(spark, sf))


@register("graph_edges")
def q_graph_edges(spark, sf):
    return graph.edges(_updates(spark, sf))


@register("graph_used_device")
def q_graph_used_device(spark, sf):
    return graph.used_device(_updates(spark, sf))


@register("graph_used_ip")
def q_graph_used_ip(spark, sf):
    return graph.used_ip(_updates(spark, sf))


@register("graph_edge_report")
def q_graph_edge_report(spark, sf):
    return graph.edge_report(graph.edges(_updates(spark, sf)))


@register("graph_edge_versions")
def q_graph_edge_versions(spark, sf):
    return graph.edge_versions(_updates(spark, sf)).select(
        *graph.EDGE_COLUMNS, F.col("valid_from.ts").alias("valid_from_ts"),
        F.col("valid_from.id").alias("valid_from_event_id"), F.col("valid_to.ts").alias("valid_to_ts"),
        F.col("valid_to.id").alias("valid_to_event_id"))


# ---------------------------------------------------------------- cycles
@register("circular_flow")
def q_circular_flow(spark, sf):
    return flat_paths(cycles.circular_flow(_valid(spark, sf), DRIVER_CYCLE))


@register("circular_flow_snapshot")
def q_circular_flow_snapshot(spark, sf):
    return flat_paths(cycles.circular_flow_snapshot(_valid(spark, sf), DRIVER_CYCLE))


@register("circular_alert")
def q_circular_alert(spark, sf):
    return flat_alert_events(jobs.cycle_alerts(_valid(spark, sf), DRIVER_CYCLE))


#: Rounds of the trimming query; the SQL check unrolls as many.
TRIM_ROUNDS = 6


@register("cycle_prefilter")
def q_cycle_prefilter(spark, sf):
    return cycles.prefilter(graph.edges(_updates(spark, sf)), _valid(spark, sf), DRIVER_CYCLE, TRIM_ROUNDS)


# ---------------------------------------------------------------- evaluation
def _matched(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The rules' alerts against those of a run in event order that drops nothing."""
    valid = _valid(spark, sf)
    expected = evaluation.expected_alerts(act.activity(valid, DRIVER_RULES), DRIVER_RULES)
    canon = alerts.canonical(jobs.rule_alerts(valid, DRIVER_RULES))
    return evaluation.match(expected, canon), valid.select(F.lit("EVENT").alias("kind"))


@register("evaluation_match")
def q_evaluation_match(spark, sf):
    return _matched(spark, sf)[0]


@register("evaluation_metrics")
def q_evaluation_metrics(spark, sf):
    m, injected = _matched(spark, sf)
    return evaluation.metrics(m, injected)


@register("detection_latency")
def q_detection_latency(spark, sf):
    return evaluation.detection_latency(_matched(spark, sf)[0])


@register("evaluation_misses")
def q_evaluation_misses(spark, sf):
    return evaluation.misses(_matched(spark, sf)[0])


# ---------------------------------------------------------------- metrics
@register("alerts_per_minute")
def q_alerts_per_minute(spark, sf):
    return metrics.alerts_per_minute(alerts.canonical(_fixture_alert_events(spark, sf)))


@register("dead_letters_per_minute")
def q_dead_letters_per_minute(spark, sf):
    decoded = intake.json_decode(messages(spark, sf))
    return metrics.dead_letters_per_minute(jobs.dead_letter_table(_raw(spark, sf), decoded, _fixture_alert_events(spark, sf)))
