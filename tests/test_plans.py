"""Plan shape: the properties the scale design relies on, checked on the
physical plans Spark actually produces."""

import re

from flowwatch.config import DRIVER_CYCLE, DRIVER_RULES
from flowwatch.operators import activity, alerts, cycles, graph, ledger, normalise, rules
from flowwatch.sources.tables import load_transactions
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _valid(spark):
    return normalise.validated(load_transactions(spark, SF))


def test_first_crossing_cuts_groups_before_the_shuffle(spark):
    v = _valid(spark)
    p = formatted(rules.first_crossing(activity.activity(v, DRIVER_RULES), DRIVER_RULES, materialize=False))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_first_crossing_reads_the_rows_twice(spark):
    """Once for the (group, counterparty) table, once for counts up to the crossing; arrays only in the last aggregates."""
    act = activity.activity(_valid(spark), DRIVER_RULES)
    lazy = formatted(rules.first_crossing(act, DRIVER_RULES, materialize=False))
    assert "array" not in "".join(re.findall(r"\(\d+\) Exchange\n(?:.*\n)*?\n", lazy.split("collect_")[0]))
    rows, per_cp, cross = rules._shared(act, DRIVER_RULES, True)
    last = formatted(rules._candidates(rows, per_cp, cross, DRIVER_RULES))
    scans = re.findall(r"InMemoryFileIndex \[[^\]]*?/kept/(rule-\w+)-", last)
    assert sorted(scans) == ["rule-counterparties", "rule-crossings", "rule-crossings", "rule-rows"]
    assert formatted(rules.counterparties(rows)).count("Scan parquet") >= 1
    assert "WindowGroupLimit" not in last and "array" not in re.search(r"ReadSchema: struct<(.*?)>\n", last).group(1)


def test_evidence_stays_in_rows(spark):
    p = formatted(rules.evidence(_valid(spark), DRIVER_RULES))
    assert "collect_" not in p and "array<" not in p


def test_winners_are_aggregates_not_windows(spark):
    v = _valid(spark)
    ev = spark.createDataFrame([], "alert_id string, deduplication_key string, rule_type string, "
                               "primary_account_id string, status string, involved_accounts array<string>, "
                               "transaction_ids array<string>, generated_at timestamp, trigger_event_id string")
    for df in (ledger.ledger(v), graph.processed(v), graph.edges(graph.processed(v)), alerts.canonical(ev)):
        p = plan(df)
        assert "Window " not in p and "WindowGroupLimit" not in p
        assert "Aggregate" in p


def test_no_unpartitioned_window_over_rows(spark):
    v = _valid(spark)
    late = rules.late_events(activity.activity(v, DRIVER_RULES), DRIVER_RULES)
    versions = graph.edge_versions(graph.processed(v))
    for df in (late, versions):
        found = list(re.finditer(r"Window \[.*?\], \[(.*?)\], \[", plan(df)))
        assert found
        for m in found:
            assert m.group(1).strip(), "window without partition keys"


def test_cycle_hops_join_on_account_time_band_and_arrival_slot(spark):
    p = formatted(cycles.circular_flow(_valid(spark), DRIVER_CYCLE, prefilter_edges=False, materialize=False))
    joins = re.findall(r"Left keys \[\d+\]: \[(.*?)\]", p)
    hop_joins = [j for j in joins if "tail" in j or "head" in j]
    assert hop_joins and all(all(k in j for k in ("_b#", "_a#", "_l#", "_s#")) for j in hop_joins)
    closing = [j for j in hop_joins if "tail" in j and "head" in j]
    assert len(closing) == DRIVER_CYCLE.max_depth - 1          # a path is complete when one edge joins both ends
    assert any("head" in j and "tail" not in j for j in hop_joins) and any("tail" in j and "head" not in j for j in hop_joins)


def test_lookup_opens_few_files_for_every_key(spark, tmp_path):
    v = _valid(spark)
    index_path = str(tmp_path / "index")
    ledger.index_rows(ledger.ledger(v), 8).write.partitionBy(*ledger.INDEX_PARTS).parquet(index_path)
    index = spark.read.parquet(index_path)
    ranges = ledger.index_ranges(index)
    whole = ledger.ledger(v)
    every = len(index.inputFiles())
    start, end = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-02-01").cast("timestamp_ntz")
    for by, column in ledger.LOOKUP_COLUMNS.items():
        key = whole.where(F.col(column).isNotNull() & (F.col(column) != "")).agg(F.min(column)).first()[0]
        found = ledger.lookup_index(index, ranges, by, key, start, end)
        want = whole.where((F.col(column) == key) & (F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
        assert sorted(map(tuple, found.select(whole.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        p = formatted(found)
        assert re.search(r"PartitionFilters: \[.*lookup.*part", p) and re.search(r"PushedFilters: \[.*EqualTo\(key", p)
        assert found.select("transaction_id").inputFiles() is not None
        opened = spark.read.parquet(index_path).where((F.col("lookup") == by)).select("part").distinct().count()
        parts = ranges.where((F.col("lookup") == by) & (F.col("low_key") <= key) & (F.col("high_key") >= key)).count()
        assert parts < opened <= 8 < every


def test_scan_reads_only_needed_columns(spark):
    v = load_transactions(spark, SF)
    p = formatted(normalise.outcome_counts(v).select("event_count"))
    schema = re.search(r"ReadSchema: struct<(.*?)>", p).group(1)
    assert "correlation_id" not in schema and "device_id" not in schema
