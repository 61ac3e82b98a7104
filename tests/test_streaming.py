import os
import tempfile

import pytest
from pyspark.sql import functions as F

from flowwatch.config import RuleConfig
from flowwatch.operators import graph, normalise, rules
from flowwatch.sources.tables import load_transactions
from flowwatch.streaming.io import read_stream
from flowwatch.streaming.rules import stream_candidates
from flowwatch.streaming.sinks import GraphSink, IdempotentSink

SF = "/root/testdata/sf0.001"
# grace wider than the fixture's replay delay (2 h + 20 min), so no row is late
CFG = RuleConfig("SHARED_DEVICE", 86400, 3 * 86400, 3)


def _files_by_arrival(spark, df, parts=5):
    """Write rows as ``parts`` parquet files in arrival order (one per trigger)."""
    root = tempfile.mkdtemp(prefix="fw-stream-", dir="/tmp")
    ranked = df.withColumn("_part", F.ntile(parts).over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("ingested_at", "event_id")))
    for p in range(1, parts + 1):
        ranked.where(F.col("_part") == p).drop("_part").coalesce(1).write.parquet(os.path.join(root, f"in/p{p:02d}"))
    return root


def _valid_ts(spark):
    v = normalise.validated(load_transactions(spark, SF))
    return v.withColumn("occurred_at", F.col("occurred_at").cast("timestamp")) \
            .withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))


def test_stream_equals_batch_and_sink_is_idempotent(spark):
    valid = _valid_ts(spark)
    batch = {(r.deduplication_key, r.trigger_event_id, r.distinct_accounts_count, r.transaction_count,
              tuple(r.involved_accounts), tuple(r.transaction_ids))
             for r in rules.candidates(valid, (CFG,)).collect()}
    root = _files_by_arrival(spark, valid)
    schema = valid.schema
    paths = [os.path.join(root, "in", d) for d in sorted(os.listdir(os.path.join(root, "in")))]
    # one directory per trigger, replayed in order
    sink = IdempotentSink(os.path.join(root, "candidates"), ["deduplication_key"], ["generated_at"])
    ckpt = os.path.join(root, "ckpt")
    stream_dir = os.path.join(root, "stream")
    os.makedirs(stream_dir)
    for i, p in enumerate(paths):
        for f in os.listdir(p):
            if f.endswith(".parquet"):
                os.link(os.path.join(p, f), os.path.join(stream_dir, f"b{i:02d}-{f}"))
        src = read_stream(spark, "parquet", schema, stream_dir)
        q = (stream_candidates(src, CFG).writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
    got = {(r.deduplication_key, r.trigger_event_id, r.distinct_accounts_count, r.transaction_count,
            tuple(r.involved_accounts), tuple(r.transaction_ids))
           for r in sink.read(spark).collect()}
    assert got == batch and len(batch) > 10
    # replaying every row as a new batch adds nothing
    before = sink.read(spark).count()
    sink(spark.read.parquet(os.path.join(root, "candidates")).drop("batch_id"), 999)
    assert sink.read(spark).count() == before


def test_graph_and_cycles_equal_batch(spark):
    """Five micro-batches, the last one retried: nodes and edges (G2-G5) and cycle alerts (C3) equal the batch operators."""
    from flowwatch.config import DRIVER_CYCLE
    from flowwatch.operators import activity, alerts
    from flowwatch.plans import jobs
    from flowwatch.streaming.sinks import AlertSink, CycleSink
    valid = _valid_ts(spark).persist()
    root = tempfile.mkdtemp(prefix="fw-graph-", dir="/tmp")
    sink = GraphSink(os.path.join(root, "graph"), buckets=4)
    found = AlertSink(os.path.join(root, "alerts"), buckets=2)
    cycle_sink = CycleSink(sink, found, DRIVER_CYCLE)
    ordered = _in_batches(valid, 5).persist()
    for b in (1, 2, 3, 4, 5, 5):
        batch = ordered.where(F.col("_b") == b).drop("_b")
        cycle_sink(batch, b)
        sink(batch, b)
    sink(ordered.where(F.col("_b") == 2).drop("_b"), 2)       # a batch that others have built upon changes nothing
    applied = graph.processed(activity.graph_updates(valid).drop("key"))
    for got, want in ((sink.edges(spark), graph.edges(applied)), (sink.read(spark, "accounts"), graph.accounts(applied)),
                      (sink.read(spark, "used_device"), graph.used_device(applied)), (sink.read(spark, "used_ip"), graph.used_ip(applied))):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    per_bucket = [len(v) for v in sink.edge_table.segments(spark).values()]
    assert max(per_bucket) <= 2                               # the last version and the one its replay starts from
    want = alerts.canonical(jobs.cycle_alerts(valid, DRIVER_CYCLE))
    got = sorted(map(tuple, found.read_alerts(spark).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 5


def test_history_does_not_add_files_to_a_batch(spark):
    """S6 over 14 batches: a batch opens a bounded number of files, compaction loses nothing, and a replayed batch is exact."""
    root = tempfile.mkdtemp(prefix="fw-keyed-", dir="/tmp")
    sink = IdempotentSink(os.path.join(root, "t"), ["k"], buckets=2, compact_after=4)
    rows = lambda b: spark.createDataFrame([(f"{b}-{i}" if i % 2 else f"{b // 2}-{i}", b) for i in range(6)], "k string, b int")
    opened, created = [], 0
    for b in range(14):
        created += sink(rows(b), b)
        opened.append(len(sink.table.paths(spark)))
    assert max(opened) <= 2 * (4 + 1)                         # per bucket a compacted segment and up to four batches
    want = {}
    for b in range(14):
        for r in rows(b).collect():
            want.setdefault(r.k, b)
    first = sorted((r.k, r.batch_id) for r in sink.read(spark).collect())
    assert first == sorted(want.items()) and created == len(want)
    sink(rows(13), 13)                                        # the last batch again
    sink(rows(5), 5)                                          # one that has been compacted
    sink(rows(3), 99)                                         # old rows as a new batch
    assert sorted((r.k, r.batch_id) for r in sink.read(spark).collect()) == first


def test_counters_follow_the_alerts(spark):
    """M3: created, duplicate and dead as A5 and S3 count them; a retried batch counts once."""
    from flowwatch.operators import alerts
    from flowwatch.streaming.sinks import AlertSink
    columns = ("alert_id string, deduplication_key string, rule_type string, primary_account_id string, status string, "
               "involved_accounts array<string>, transaction_ids array<string>, generated_at timestamp, trigger_event_id string")
    import datetime as dt
    at = lambda k: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=k)
    rows = [(f"a{k}", f"key{k % 4}" if k % 5 else "k" * 300, "FAN_OUT", "p", "OPEN", [f"x{k}"], [f"t{k}"], at(k), f"e{k:02d}") for k in range(20)]
    df = spark.createDataFrame(rows, columns)
    sink = AlertSink(tempfile.mkdtemp(prefix="fw-m3-", dir="/tmp"), buckets=2)
    for b, (lo, hi) in enumerate(((0, 9), (9, 20), (9, 20))):
        sink(df.where(F.col("generated_at").between(F.lit(at(lo)), F.lit(at(hi - 1)))), min(b, 1))
    stats = alerts.dedup_stats(df).collect()[0]
    assert sink.counters.totals() == {"created": stats.created, "duplicate": stats.duplicates, "dead": alerts.rejected(df).count()}
    assert spark.read.parquet(sink.dead_path).count() == alerts.rejected(df).count() == 4


def test_messages_survive_the_round_trip(spark):
    """Events written as keyed messages by a stream, read back by another and decoded."""
    from flowwatch.schemas import EVENT_COLUMNS
    from flowwatch.sources.intake import json_decode
    from flowwatch.streaming.io import as_messages, write_stream
    root = tempfile.mkdtemp(prefix="fw-io-", dir="/tmp")
    events = _valid_ts(spark).limit(300)
    events.write.parquet(os.path.join(root, "events"))
    source = read_stream(spark, "parquet", events.schema, os.path.join(root, "events"))
    write_stream(as_messages(source), "json", os.path.join(root, "ckpt"), os.path.join(root, "topic"),
                 trigger={"availableNow": True}).awaitTermination()
    topic = spark.read.schema("key string, value string").json(os.path.join(root, "topic"))
    assert topic.where("key is null").count() == 0
    back = json_decode(topic, ts_type="timestamp")
    assert back.where("decode_error is not null").count() == 0
    stored = spark.read.parquet(os.path.join(root, "events"))
    assert sorted(map(tuple, back.select(EVENT_COLUMNS).collect()), key=repr) == sorted(map(tuple, stored.select(EVENT_COLUMNS).collect()), key=repr)


def test_streaming_rule_has_no_python(spark):
    valid = _valid_ts(spark)
    plan = stream_candidates(valid, CFG)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("count, amount", [(0, 0), (6, 0), (0, 60_000), (7, 90_000)])
def test_crossing_is_looked_up_for_all_thresholds(spark, count, amount):
    """Repeated deliveries of the crossing event included; only an amount threshold needs a fold."""
    valid = _valid_ts(spark)
    valid = valid.unionByName(valid.where(F.crc32("event_id") % 3 == 0))
    cfg = RuleConfig("FAN_IN", 604800, 15, 3, count, amount)
    shown = rules.CANDIDATE_OUT
    got = stream_candidates(valid, cfg).select(shown)
    assert ("array_union" in got._jdf.queryExecution().optimizedPlan().toString()) == (amount > 0)
    want = rules.candidates(valid, (cfg,), drop_late=False).select(shown)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_sink_drops_held_keys_before_it_sorts(spark, tmp_path):
    sink = IdempotentSink(str(tmp_path / "t"), ["k"], ["at"])
    assert sink(spark.createDataFrame([("a", 2, [1]), ("a", 1, [2])], "k string, at int, v array<int>"), 0) == 1
    later = spark.createDataFrame([("a", 0, [3]), ("b", 5, [4]), ("b", 4, [5])], "k string, at int, v array<int>")
    new = sink.new_rows(later, 1)
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftAnti")
    assert [tuple(r) for r in new.select("k", "at", "v").collect()] == [("b", 4, [5])]


def test_replay_ends_without_an_empty_batch(spark, tmp_path):
    from flowwatch.streaming.flows import replay_rules
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before, valid, cfg = spark.conf.get(setting), _valid_ts(spark), RuleConfig("FAN_OUT", 604800, 3 * 86400, 5)
    found = replay_rules(valid, (cfg,), str(tmp_path), 1)
    assert spark.conf.get(setting) == before
    assert [f for f in os.listdir(tmp_path / "checkpoints" / "fan_out" / "commits") if f.isdigit()] == ["0"]
    assert {"correlation_id", "schema_version"}.isdisjoint(spark.read.parquet(str(tmp_path / "events")).columns)
    want = rules.candidates(valid, (cfg,), drop_late=False)
    key = lambda df: {(r.deduplication_key, r.trigger_event_id) for r in df.collect()}
    assert key(found) == key(want) != set()


def test_rule_streams_one_query_per_rule(spark):
    from flowwatch.streaming.rules import start_rule_streams
    valid = _valid_ts(spark)
    root = tempfile.mkdtemp(prefix="fw-rules-", dir="/tmp")
    valid.coalesce(1).write.parquet(os.path.join(root, "in"))
    cfgs = (RuleConfig("FAN_OUT", 604800, 3 * 86400, 5), CFG)
    src = read_stream(spark, "parquet", valid.schema, os.path.join(root, "in"))
    sinks = {c.rule_type: IdempotentSink(os.path.join(root, "out", c.rule_type), ["deduplication_key"])
             for c in cfgs}
    qs = start_rule_streams(src, cfgs, os.path.join(root, "ckpt"), lambda c: sinks[c.rule_type],
                            trigger={"availableNow": True})
    for q in qs:
        q.awaitTermination()
    got = {c.rule_type: sinks[c.rule_type].read(spark).count() for c in cfgs}
    want = {r.rule_type: r["count"] for r in rules.candidates(valid, cfgs).groupBy("rule_type").count().collect()}
    assert got == want


def _in_batches(df, n):
    from pyspark.sql import Window
    return df.withColumn("_b", F.ntile(n).over(Window.orderBy("ingested_at", "event_id")))


def test_ledger_sink_equals_batch_ledger(spark):
    from flowwatch.operators import ledger
    from flowwatch.streaming.sinks import LedgerSink
    valid = _valid_ts(spark)
    sink = LedgerSink(tempfile.mkdtemp(prefix="fw-ledger-", dir="/tmp"))
    parts = _in_batches(valid, 4)
    for b in (1, 2, 3, 4):
        sink(parts.where(F.col("_b") == b).drop("_b"), b)
    sink(parts.where(F.col("_b") == 3).drop("_b"), 3)           # retried batch
    cols = ledger.LEDGER_COLUMNS
    got = sorted(tuple(r) for r in sink.read(spark).select(*cols).collect())
    want = sorted(tuple(r) for r in ledger.ledger(valid).select(*cols).collect())
    assert got == want
    refused = sorted(tuple(r) for r in sink.rejects(spark).collect())
    assert refused == sorted(tuple(r) for r in ledger.constraint_rejects(valid).collect()) and len(refused) > 10
    dead = spark.read.parquet(sink.dead_path).count()
    assert dead == ledger.conflicts(valid).count() + len(refused) == sink.counters.totals()["dead"]


def test_alert_sink_equals_batch_projection(spark):
    from flowwatch.config import DRIVER_CYCLE, DRIVER_RULES
    from flowwatch.operators import alerts
    from flowwatch.plans import jobs
    from flowwatch.streaming.sinks import AlertSink
    ev = jobs.all_alert_events(normalise.validated(load_transactions(spark, SF)), DRIVER_RULES, DRIVER_CYCLE)
    ev = ev.checkpoint(eager=True)
    sink = AlertSink(tempfile.mkdtemp(prefix="fw-alerts-", dir="/tmp"))
    from pyspark.sql import Window
    parts = ev.withColumn("_b", F.ntile(3).over(Window.orderBy("generated_at", "trigger_event_id", "alert_id")))
    for b in (1, 2, 3):
        sink(parts.where(F.col("_b") == b).drop("_b"), b)
    canon = alerts.canonical(ev)
    assert sorted(tuple(r) for r in sink.read_alerts(spark).collect()) == sorted(tuple(r) for r in canon.collect())
    got = sorted(tuple(r) for r in sink.read_evidence(spark, "accounts").collect())
    assert got == sorted(tuple(r) for r in alerts.alert_accounts(ev, canon).collect())


def test_streams_from_raw_messages(spark):
    """Raw JSON messages in three arrival-ordered files -> ledger, graph and
    rule alerts equal the batch results on the same events."""
    from pyspark.sql import Window
    from flowwatch.operators import alerts, ledger
    from flowwatch.plans.catalog import messages
    from flowwatch.streaming.flows import start_streams
    msgs = messages(spark, SF).where("value NOT LIKE '\"%'")      # plain JSON only
    root = tempfile.mkdtemp(prefix="fw-flows-", dir="/tmp")
    parts = msgs.withColumn("_b", F.ntile(3).over(Window.orderBy("received_at", "id")))
    for b in (1, 2, 3):
        (parts.where(F.col("_b") == b).select("key", "value", F.col("received_at").cast("timestamp"))
         .coalesce(1).write.json(os.path.join(root, "in", f"b{b}")))
    src_dir = os.path.join(root, "src")
    os.makedirs(src_dir)
    schema = "key string, value string, received_at timestamp"
    cfgs = (CFG,)
    for b in (1, 2, 3):
        d = os.path.join(root, "in", f"b{b}")
        for f in os.listdir(d):
            if f.endswith(".json"):
                os.link(os.path.join(d, f), os.path.join(src_dir, f"b{b}-{f}"))
        src = spark.readStream.schema(schema).json(src_dir)
        qs, route, alert_sinks = start_streams(src, os.path.join(root, "run"), cfgs, {"availableNow": True})
        for q in qs:
            q.awaitTermination()
    # batch reference on the same decoded events
    from flowwatch.streaming.flows import decoded_events
    batch_rows = decoded_events(spark.read.schema(schema).json(src_dir))
    valid = batch_rows.where("failure_reason IS NULL").select(*__import__("flowwatch.schemas", fromlist=["x"]).EVENT_COLUMNS)
    cols = ledger.LEDGER_COLUMNS
    got = sorted(tuple(r) for r in route.ledger.read(spark).select(*cols).collect())
    assert got == sorted(tuple(r) for r in ledger.ledger(valid).select(*cols).collect())
    want_alerts = alerts.canonical(alerts.from_candidates(rules.candidates(valid, cfgs)))
    got_alerts = alert_sinks[CFG.rule_type].read_alerts(spark)
    assert sorted(tuple(r) for r in got_alerts.collect()) == sorted(tuple(r) for r in want_alerts.collect())
    assert got_alerts.count() > 10


def test_stream_drops_windows_closed_by_the_watermark(spark):
    """Batch 1 moves the watermark past 10:01:15; a later batch with five
    transfers in [10:00, 10:01) is late: no candidate and no failure."""
    import datetime as dt
    from conftest import T0, acct, event
    from flowwatch.schemas import TRANSACTION_EVENT
    cfg = RuleConfig("FAN_OUT", 60, 15, 5)
    root = tempfile.mkdtemp(prefix="fw-late-", dir="/tmp")
    first = [event("x", acct("Z"), acct("Y"), at=300)]                      # 10:05, watermark 10:04:45
    late = [event(f"l{i}", acct("A"), acct(f"D{i}"), at=i, arrival=400 + i) for i in range(5)]
    on_time = [event(f"o{i}", acct("B"), acct(f"E{i}"), at=290 + i, arrival=410 + i) for i in range(5)]
    src_dir = os.path.join(root, "src")
    out = []
    for n, rows in enumerate((first, late + on_time)):
        spark.createDataFrame(rows, TRANSACTION_EVENT).coalesce(1).write.parquet(os.path.join(root, f"b{n}"))
        os.makedirs(src_dir, exist_ok=True)
        for f in os.listdir(os.path.join(root, f"b{n}")):
            if f.endswith(".parquet"):
                os.link(os.path.join(root, f"b{n}", f), os.path.join(src_dir, f"b{n}-{f}"))
        src = read_stream(spark, "parquet", TRANSACTION_EVENT, src_dir)
        q = (stream_candidates(src, cfg).writeStream.outputMode("update").foreachBatch(lambda b, i: out.extend(b.collect()))
             .option("checkpointLocation", os.path.join(root, "ckpt")).trigger(availableNow=True).start())
        q.awaitTermination()
    assert [r.primary_account_id for r in out] == [acct("B")]
