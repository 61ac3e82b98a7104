import datetime as dt

from pyspark.sql import functions as F

from conftest import T0, acct, event
from flowwatch.operators import alerts, graph

ALERT_SCHEMA = ("alert_id string, deduplication_key string, rule_type string, primary_account_id string, "
                "status string, involved_accounts array<string>, transaction_ids array<string>, "
                "generated_at timestamp, trigger_event_id string")


def alert(spark_rows, spark):
    return spark.createDataFrame(spark_rows, ALERT_SCHEMA)


def a(aid, key, rule="FAN_OUT", primary="p", accounts=("x",), txs=("t",), at=0):
    return (aid, key, rule, primary, "OPEN", list(accounts), list(txs), T0 + dt.timedelta(seconds=at), "e-" + aid)


def test_alert_replay_is_one_row(spark):
    ev = alert([a("A1", "K1"), a("A1", "K1", at=5)], spark)
    assert alerts.canonical(ev).count() == 1
    assert alerts.alert_accounts(ev).count() == 1
    stats = alerts.dedup_stats(ev).collect()[0]
    assert (stats.created, stats.duplicates) == (2, 0)     # exact replay counts as created again


def test_alert_same_key_other_id_unions_evidence(spark):
    ev = alert([a("A1", "K1", accounts=("x",)), a("A2", "K1", accounts=("y",), at=5)], spark)
    canon = alerts.canonical(ev).collect()
    assert [c.alert_id for c in canon] == ["A1"]
    acc = alerts.alert_accounts(ev).collect()
    assert sorted((r.alert_id, r.account_id) for r in acc) == [("A1", "x"), ("A1", "y")]
    stats = alerts.dedup_stats(ev).collect()[0]
    assert (stats.created, stats.duplicates) == (1, 1)


def test_two_keys_two_alerts_and_rejects(spark):
    ev = alert([a("A1", "K1"), a("A2", "K2"), a("A3", "K3", rule=None), a("A4", "K" * 256)], spark)
    assert sorted(r.alert_id for r in alerts.canonical(ev).collect()) == ["A1", "A2"]
    assert sorted(r.alert_id for r in alerts.rejected(ev).collect()) == ["A3", "A4"]
    assert {r.alert_id for r in alerts.alert_transactions(ev).collect()} == {"A1", "A2"}


def test_evidence_counts(spark):
    ev = alert([a("A1", "K1", accounts=("x", "y"), txs=("t1",))], spark)
    c = alerts.canonical(ev)
    r = alerts.evidence_counts(alerts.alert_accounts(ev, c), alerts.alert_transactions(ev, c)).first()
    assert (r.account_count, r.transaction_count) == (2, 1)


def test_graph_edges(events):
    rows = [event("e1", acct("A"), acct("B"), amount=1000, at=0, tx="t1"),
            event("e1", acct("A"), acct("B"), amount=1000, at=0, tx="t1", arrival=5),   # replay
            event("e2", acct("A"), acct("B"), amount=2500, at=60, tx="t2"),
            event("e3", acct("A"), acct("B"), amount=10, at=60, tx="t3", arrival=70),   # equal time, later
            event("e4", acct("A"), acct("B"), amount=7, currency="EUR", device=None, ip=""),
            event("e5", acct("C"), acct("A"), device="  ", ip=None)]
    upd = graph.processed(events(rows))
    e = {(r.src, r.dst, r.currency): r for r in graph.edges(upd).collect()}
    usd = e[(acct("A"), acct("B"), "USD")]
    assert (usd.transaction_count, usd.total_amount_minor, usd.latest_transaction_id) == (3, 3510, "t2")
    assert (acct("A"), acct("B"), "EUR") in e and len(e) == 3
    devices = {(r.account_id, r.device_id) for r in graph.used_device(upd).collect()}
    assert devices == {(acct("A"), "dev-1"), (acct("C"), "  ")}      # blank-but-not-empty makes a node
    assert {r.ip_hash for r in graph.used_ip(upd).collect()} == {"ip-1"}
    assert graph.accounts(upd).count() == 3


def test_edge_versions_as_of(events):
    rows = [event("e1", acct("A"), acct("B"), amount=1000, at=0, tx="t1"),
            event("e2", acct("A"), acct("B"), amount=2500, at=60, tx="t2")]
    v = graph.edge_versions(graph.processed(events(rows))).orderBy("valid_from").collect()
    assert [(r.transaction_count, r.total_amount_minor, r.latest_transaction_id) for r in v] == \
        [(1, 1000, "t1"), (2, 3500, "t2")]
    assert v[0].valid_to == v[1].valid_from and v[1].valid_to is None


def test_edge_versions_bucket_split_is_exact(spark):
    from flowwatch.operators import normalise
    from flowwatch.sources.tables import load_transactions
    upd = graph.processed(normalise.validated(load_transactions(spark, "/root/testdata/sf0.001")))
    fine = sorted(tuple(r) for r in graph.edge_versions(upd, bucket_seconds=1).collect())
    coarse = sorted(tuple(r) for r in graph.edge_versions(upd, bucket_seconds=10 ** 8).collect())
    assert fine == coarse and len(fine) > 900
