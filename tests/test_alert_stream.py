"""The alert stream's work per event: ids are packed once, paths are closed by the joins that make them longer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import T0, acct, event
from flowwatch.config import DEFAULT_RULES, CycleConfig, RuleConfig
from flowwatch.functions import epoch_micros, epoch_seconds, not_blank
from flowwatch.operators import cycles, rules
from flowwatch.operators.activity import activity, packed_events
from flowwatch.plans import jobs

CFG = CycleConfig(4, 86400, 50)
A, B, C, D = (acct(x) for x in "ABCD")


def ring(*accounts):
    return [event(f"r{k}", a, b, at=k) for k, (a, b) in enumerate(zip(accounts, accounts[1:] + accounts[:1]))]


def test_paths_close_in_the_join_that_makes_them_longer(events, monkeypatch):
    """Only the longest paths are joined between both ends; before, those of every length were."""
    met, meeting = [], cycles._meeting
    monkeypatch.setattr(cycles, "_meeting", lambda f, e, c, a, ends: met.append(len(ends)) or meeting(f, e, c, a, ends))
    rows = ring(A, B) + [event("x", B, C, at=3), event("y", C, A, at=4), event("z", C, D, at=5), event("w", D, A, at=6)]
    got = {(r.cand_event_id, r.depth, tuple(r.path_transactions)) for r in cycles.circular_flow(events(rows), CFG).collect()}
    assert met.count(2) == 1
    assert {("r1", 1, ("tx-r0",)), ("y", 2, ("tx-r0", "tx-x")), ("w", 3, ("tx-r0", "tx-x", "tx-z"))} <= got
    lazy = {(r.cand_event_id, r.depth, tuple(r.path_transactions)) for r in cycles.circular_flow(events(rows), CFG, materialize=False).collect()}
    assert lazy == got


@pytest.mark.parametrize("name", [acct, lambda x: f"account {x}"])
def test_ids_are_packed_before_they_are_dealt_to_the_rules(events, monkeypatch, name):
    def again(_):
        raise AssertionError("checked and packed per rule and row")

    monkeypatch.setattr(rules, "_packed", again)
    rows = [event(f"e{k}", name("S"), name(f"T{k}"), at=k, device="phone", ip=" " if k else " ") for k in range(6)]
    rows += [event(f"f{k}", name(f"U{k}"), name("V"), at=k, device="phone", ip=None) for k in range(3)]
    got = {c.rule_type: c for c in rules.candidates(events(rows), DEFAULT_RULES).collect()}
    assert set(got) == {"FAN_OUT", "SHARED_DEVICE"}
    assert got["FAN_OUT"].primary_account_id == name("S") and got["FAN_OUT"].involved_accounts == sorted(name(f"T{k}") for k in range(5))
    assert got["SHARED_DEVICE"].deduplication_key.startswith("SHARED_DEVICE-phone-USD-") and got["SHARED_DEVICE"].distinct_accounts_count == 3


def test_activity_of_packed_events_is_that_of_their_texts(events):
    rows = events([event("e1", A, B, device="phone", ip=""), event("e2", B, A, device="\t", ip="ip"), event("e3", A, C, device=None, ip="é")])
    plain = {(r.rule_type, r.key, r.event_id) for r in activity(rows, DEFAULT_RULES).collect()}
    packed, kinds = packed_events(rows)
    assert kinds == ["account"]
    bytes_of = {a: bytes.fromhex(a.replace("-", "")) for a in (A, B, C)}
    assert {(r.rule_type, bytes(r.key), r.event_id) for r in activity(packed, DEFAULT_RULES).collect()} == {
        (t, bytes_of.get(k, k.encode()), e) for t, k, e in plain}
    one = (RuleConfig("SHARED_DEVICE", 60, 15, 1),)
    assert [r.key for r in activity(packed, one).collect()] == ["phone"]


def test_both_producers_read_events_written_once(spark, events, monkeypatch):
    written, keep = [], jobs.kept
    monkeypatch.setattr(jobs, "kept", lambda df, name: written.append(name) or keep(df, name))
    got = jobs.all_alert_events(events(ring(A, B, C)), DEFAULT_RULES, CFG).collect()
    assert written == ["events"]
    assert {r.rule_type: r.transaction_ids for r in got} == {t: ["tx-r0", "tx-r1", "tx-r2"] for t in ("CIRCULAR_FLOW", "SHARED_DEVICE", "SHARED_IP")}


def test_seconds_round_down_at_every_instant(spark):
    at = [dt.datetime(1, 1, 1, 0, 0, 0, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1970, 1, 1), dt.datetime(1970, 1, 3),
          dt.datetime(1970, 1, 3, 0, 0, 0, 999999), T0, dt.datetime(2024, 1, 1, 1, 2, 3, 999999), None]
    df = spark.createDataFrame([(t,) for t in at], "t timestamp_ntz")
    for c in (F.col("t"), F.col("t").cast("timestamp")):
        assert [r[0] == r[1] for r in df.select(epoch_seconds(c), F.floor(epoch_micros(c) / 1_000_000)).collect() if r[1] is not None] == [True] * 7
    assert df.where("t is null").select(epoch_seconds(F.col("t"))).first()[0] is None


def test_blank_texts_with_visible_and_other_first_characters(spark):
    texts = ["a", "~ ", "!", " a", " ", " ", " é", "é", "", "\t\n", None, "\x7f"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(not_blank(F.col("t"))).collect()]
    assert got == [True, True, True, True, True, False, True, True, False, False, False, True]
