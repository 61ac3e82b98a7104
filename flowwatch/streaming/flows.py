"""The reference's topology as Structured Streaming queries over raw messages.

* routing query: decode (S2) -> validate (N1/N2) -> per micro-batch, write
  validated events, invalid records and dead letters, feed the ledger (L1, L2, L4)
  and graph (G8) projectors and search the batch's transactions as ends of cycles (C1, C3);
* one query per rule (W7), each decoding and validating in-plan (a pure
  projection, no intermediate topic), writing its alert events (A1) to an
  alert projector (A2-A4).

Every sink writes its own ``batch_id`` partition, so a restarted query that
replays a batch rewrites exactly that batch.
"""

from __future__ import annotations

import os
from contextlib import contextmanager, nullcontext
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch.config import DEFAULT_CYCLE, DEFAULT_RULES, CycleConfig
from flowwatch.functions import epoch_micros
from flowwatch.operators import alerts, normalise
from flowwatch.operators.activity import RULE_EVENT, graph_update_failures
from flowwatch.schemas import EVENT_COLUMNS
from flowwatch.sources.intake import dead_letters, json_decode
from flowwatch.streaming.io import read_stream
from flowwatch.streaming.rules import start_rule_streams, stream_candidates
from flowwatch.streaming.sinks import AlertSink, CycleSink, GraphSink, IdempotentSink, LedgerSink, RunCounters, write_batch
from flowwatch.streaming.store import BATCH


def decoded_events(messages: DataFrame) -> DataFrame:
    """Messages ``(key, value, received_at)`` -> decoded rows with ``failure_reason``."""
    d = json_decode(messages, ts_type="timestamp").where(F.col("decode_error").isNull())
    return normalise.classify(d, null_event="null_event")


class RouteSink:
    """Validated events, invalid records, dead letters, ledger, graph and cycle alerts of each batch."""

    def __init__(self, root: str, cycle: CycleConfig = DEFAULT_CYCLE):
        self.root = root
        self.ledger = LedgerSink(os.path.join(root, "ledger"))
        self.graph = GraphSink(os.path.join(root, "graph"))
        self.cycle_alerts = AlertSink(os.path.join(root, "alerts", "circular_flow"))
        self.cycles = CycleSink(self.graph, self.cycle_alerts, cycle)
        self.counters = RunCounters()

    def _write(self, df: DataFrame, name: str, batch_id: int) -> int:
        return write_batch(df, os.path.join(self.root, name), batch_id)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        decoded = json_decode(batch, ts_type="timestamp").persist()
        try:
            bad = decoded.where(F.col("decode_error").isNotNull())
            dead = self._write(dead_letters(bad, "normalisation", "transactions.raw", F.col("key"), F.col("value"),
                                            F.col("decode_error"), F.col("received_at")), "dead_letters", batch_id)
            rows = normalise.classify(decoded.where(F.col("decode_error").isNull()), null_event="null_event")
            valid = rows.where(F.col("failure_reason").isNull()).select(*EVENT_COLUMNS)
            n_valid = self._write(valid, "validated", batch_id)
            refused = graph_update_failures(valid)
            dead += self._write(dead_letters(refused, "graph", "graph.updates", F.col("source_account_id"), F.to_json(F.struct(*EVENT_COLUMNS)),
                                             F.lit("correlation_id is not a UUID"), F.col("ingested_at")), "graph_dead_letters", batch_id)
            n_invalid = self._write(rows.where(F.col("failure_reason").isNotNull())
                        .select(F.struct(*EVENT_COLUMNS).alias("event"), "failure_reason",
                                F.col("received_at").alias("failed_at")), "invalid", batch_id)
            self.ledger(valid, batch_id)
            self.cycles(valid, batch_id)
            self.graph(valid, batch_id)
            self.counters.add(batch_id, valid=n_valid, invalid=n_invalid, dead=dead)
        finally:
            decoded.unpersist()


def start_streams(messages: DataFrame, root: str, rules=DEFAULT_RULES, trigger: dict | None = None,
                  cycle: CycleConfig = DEFAULT_CYCLE):
    """Start the routing query and one rule query per rule; returns the queries
    and the sinks (for reading results)."""
    route = RouteSink(os.path.join(root, "tables"), cycle)
    queries = []

    def start(df, sink, name, mode="append"):
        w = df.observe(name, F.count(F.lit(1)).alias("rows")).writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", os.path.join(root, "checkpoints", name))
        if trigger:
            w = w.trigger(**trigger)
        queries.append(w.queryName(name).start())

    start(messages, route, "route")
    alert_sinks = {}
    for cfg in rules:
        valid = decoded_events(messages).where(F.col("failure_reason").isNull()).select(*EVENT_COLUMNS)
        sink = AlertSink(os.path.join(root, "tables", "alerts", cfg.rule_type.lower()))
        alert_sinks[cfg.rule_type] = sink

        def to_alerts(batch, batch_id, sink=sink):
            sink(alerts.from_candidates(batch), batch_id)
        start(stream_candidates(valid, cfg), to_alerts, f"rule_{cfg.rule_type.lower()}", "update")
    return queries, route, alert_sinks


def rows_in(query) -> int:
    """M3: rows that the query has handed to its sink, as its progress reports observed them."""
    return sum(row[0] for p in query.recentProgress for row in p.observedMetrics.values())


_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def _no_empty_batch(spark: SparkSession):
    """Queries started inside run no further batch after their data: it would only clear state that nothing reads again."""
    before = spark.conf.get(_EMPTY_BATCHES, None)
    spark.conf.set(_EMPTY_BATCHES, "false")
    try:
        yield
    finally:
        spark.conf.unset(_EMPTY_BATCHES) if before is None else spark.conf.set(_EMPTY_BATCHES, before)


def replay_rules(events: DataFrame, rules, root: str, batches: int = 3) -> DataFrame:
    """Candidates of the streaming rules over given validated events, which come in as many files by arrival.

    After each batch every rule's query runs over what is new and stops; its state and its sink go on from there.
    """
    spark, events = events.sparkSession, events.select(*RULE_EVENT)
    micros = epoch_micros(F.col("ingested_at"))
    cuts = events.agg(F.percentile_approx(micros, [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    nth = sum(((micros > cut).cast("int") for cut in cuts), F.lit(0))
    source = os.path.join(root, "events")
    sinks = {cfg.rule_type: IdempotentSink(os.path.join(root, "candidates", cfg.rule_type.lower()), ["deduplication_key"],
                                           ["generated_at", "trigger_event_id"]) for cfg in rules}
    for b in range(batches):
        events.where(nth == b).write.mode("append").parquet(source)
        stream = read_stream(spark, "parquet", events.schema, source)
        with _no_empty_batch(spark) if b == batches - 1 else nullcontext():
            running = start_rule_streams(stream, rules, os.path.join(root, "checkpoints"), lambda cfg: sinks[cfg.rule_type],
                                         {"availableNow": True})
        for query in running:
            query.awaitTermination()
    return reduce(DataFrame.unionByName, [sinks[cfg.rule_type].read(spark).drop(BATCH) for cfg in rules])
