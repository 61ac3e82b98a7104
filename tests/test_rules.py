from pyspark.sql import functions as F

from conftest import T0, acct, event
from flowwatch.config import RuleConfig
from flowwatch.functions import name_uuid
from flowwatch.operators import rules
from flowwatch.operators.activity import activity

FO = RuleConfig("FAN_OUT", 60, 15, 5)
FI = RuleConfig("FAN_IN", 60, 15, 5)
SD = RuleConfig("SHARED_DEVICE", 60, 15, 3)
SI = RuleConfig("SHARED_IP", 60, 15, 3)


def cands(events, rows, cfgs):
    return rules.candidates(events(rows), cfgs).collect()


def test_fan_out_below_threshold(events):
    rows = [event(f"e{i}", acct("A"), acct(f"D{i}"), at=i) for i in range(4)]
    assert cands(events, rows, (FO,)) == []


def test_fan_out_fires_once_at_fifth_destination(events):
    rows = [event(f"e{i}", acct("A"), acct(f"D{i}"), at=i) for i in range(5)]
    rows.append(event("e5", acct("A"), acct("D5"), at=10))
    out = cands(events, rows, (FO,))
    assert len(out) == 1
    c = out[0]
    assert (c.distinct_accounts_count, c.transaction_count, c.total_amount_minor) == (5, 5, 5000)
    assert c.trigger_event_id == "e4" and c.primary_account_id == acct("A")
    assert c.deduplication_key == f"FAN_OUT-{acct('A')}-USD-{int(T0.timestamp() * 1000)}"
    assert sorted(c.involved_accounts) == sorted(acct(f"D{i}") for i in range(5))
    assert c.generated_at == T0.replace(second=4)


def test_fan_out_same_destination_never_fires(events):
    rows = [event(f"e{i}", acct("A"), acct("D"), at=i) for i in range(5)]
    assert cands(events, rows, (FO,)) == []


def test_fan_out_two_windows_two_candidates(events):
    rows = [event(f"a{i}", acct("A"), acct(f"D{i}"), at=i) for i in range(5)]
    rows += [event(f"b{i}", acct("A"), acct(f"E{i}"), at=61 + i) for i in range(5)]
    assert len(cands(events, rows, (FO,))) == 2


def test_fan_in_mirror(events):
    rows = [event(f"e{i}", acct(f"S{i}"), acct("B"), at=i) for i in range(5)]
    out = cands(events, rows, (FI,))
    assert len(out) == 1 and out[0].primary_account_id == acct("B")
    assert cands(events, rows[:4], (FI,)) == []


def test_shared_device_and_ip(events, spark):
    rows = [event(f"e{i}", acct(f"S{i}"), acct(f"D{i}"), at=i, device="DEV-SHARED-001", ip="hash123")
            for i in range(3)]
    rows.append(event("e3", acct("S3"), acct("D3"), at=10, device="DEV-SHARED-001", ip="hash123"))
    out = {c.rule_type: c for c in cands(events, rows, (SD, SI))}
    assert out["SHARED_DEVICE"].primary_account_id == "9022ee8d-1551-3fd8-8ce2-07dd9e12db39"
    assert out["SHARED_IP"].primary_account_id == "35e5d160-921d-331d-9114-f1b4ee5f9d55"
    assert out["SHARED_DEVICE"].distinct_accounts_count == 3
    assert cands(events, rows[:2], (SD, SI)) == []


def test_blank_device_is_not_a_key(events):
    rows = [event(f"e{i}", acct(f"S{i}"), acct(f"D{i}"), at=i, device="  ", ip=None) for i in range(4)]
    assert cands(events, rows, (SD, SI)) == []


def test_currency_splits_groups(events):
    rows = [event(f"e{i}", acct("A"), acct(f"D{i}"), at=i, currency="USD" if i % 2 else "EUR") for i in range(6)]
    assert cands(events, rows, (FO,)) == []


def test_count_and_amount_thresholds(events):
    rows = [event(f"e{i}", acct("A"), acct(f"D{min(i, 4)}"), amount=100, at=i) for i in range(8)]
    # distinct 5 reached at e4; count 7 at e6; amount 800 at e7
    assert cands(events, rows, (RuleConfig("FAN_OUT", 60, 15, 5, min_count=7),))[0].trigger_event_id == "e6"
    out = cands(events, rows, (RuleConfig("FAN_OUT", 60, 15, 5, min_amount=800),))
    assert out[0].trigger_event_id == "e7" and out[0].total_amount_minor == 800
    assert cands(events, rows, (RuleConfig("FAN_OUT", 60, 15, 5, min_amount=801),)) == []


def test_first_crossing_follows_arrival_not_event_time(events):
    # e4 happens last but arrives third: the crossing is the 5th *arrival*
    rows = [event(f"e{i}", acct("A"), acct(f"D{i}"), at=i, arrival=[0, 1, 3, 4, 2][i]) for i in range(5)]
    rows.append(event("e5", acct("A"), acct("D5"), at=5, arrival=30))
    out = cands(events, rows, (FO,))
    assert out[0].trigger_event_id == "e3"


def test_window_final_equals_first_crossing_groups(events):
    rows = [event(f"e{i}", acct("A"), acct(f"D{i % 7}"), at=i * 7) for i in range(40)]
    act = activity(events(rows), (FO,))
    final = {r.window_start for r in rules.window_final(act, (FO,)).collect()}
    first = {r.window_start for r in rules.first_crossing(act, (FO,)).collect()}
    assert final == first and final


def test_late_events_at_window_end_plus_grace(events):
    # window [10:00,10:01) closes at 10:01:15 of stream time
    rows = [event("a", acct("A"), acct("D1"), at=0, arrival=0),
            event("b", acct("A"), acct("D2"), at=74, arrival=1),           # stream time 10:01:14
            event("c", acct("A"), acct("D3"), at=5, arrival=2),            # kept (one second before)
            event("d", acct("A"), acct("D4"), at=75, arrival=3),           # stream time 10:01:15
            event("e", acct("A"), acct("D5"), at=6, arrival=4)]            # dropped
    late = rules.late_events(activity(events(rows), (FO,)), (FO,), bucket_seconds=2).collect()
    assert [r.event_id for r in late] == ["e"]
    kept = rules.candidates(events(rows), (FO,), drop_late=True, bucket_seconds=2).collect()
    assert kept == []


def test_evidence_explodes(events):
    rows = [event(f"e{i}", acct("A"), acct(f"D{i}"), at=i) for i in range(5)]
    c = rules.candidates(events(rows), (FO,))
    assert rules.evidence_accounts(c).count() == 5 and rules.evidence_transactions(c).count() == 5


def test_crossing_event_delivered_twice_counts_once(events):
    rows = [event(f"e{i}", acct("A"), acct(f"D{i}"), at=i) for i in range(5)]
    c = cands(events, rows + [rows[-1]], (FO,))[0]
    assert (c.distinct_accounts_count, c.transaction_count, c.total_amount_minor) == (5, 5, 5000)
    # an earlier copy counts; a copy of the last event counts where a threshold needs it
    assert cands(events, rows + [rows[0]], (FO,))[0].transaction_count == 6
    need = RuleConfig("FAN_OUT", 60, 15, 5, min_count=6)
    assert cands(events, rows + [rows[-1]] * 3, (need,))[0].transaction_count == 6
    need = RuleConfig("FAN_OUT", 60, 15, 5, min_amount=6500)
    assert cands(events, rows + [rows[-1]] * 3, (need,))[0].total_amount_minor == 7000


def test_stream_time_crosses_spans_of_buckets(events):
    rows = [event("a", acct("A"), acct("D1"), at=0, arrival=0),
            event("b", acct("A"), acct("D2"), at=90, arrival=2),
            event("c", acct("A"), acct("D3"), at=5, arrival=3 * 3600),     # stream time from two spans before
            event("d", acct("A"), acct("D4"), at=80, arrival=3 * 3600 + 1)]
    late = rules.late_events(activity(events(rows), (FO,)), (FO,)).collect()
    assert [r.event_id for r in late] == ["c"]


def test_expected_alerts_follow_event_time(events):
    from flowwatch.operators import evaluation
    rows = [event(f"e{i}", acct("A"), acct(f"D{i}"), at=i, arrival=10 * i + 3) for i in range(5)]
    e = evaluation.expected_alerts(activity(events(rows), (FO,)), (FO,)).collect()
    assert [r.trigger_at for r in e] == [T0.replace(second=4)]


def test_late_rows_are_those_behind_the_stream_time(events):
    """The look-up of closings drops exactly W9's rows, windows without events of their own included, and moves no row."""
    import random
    rng = random.Random(3)
    rows, at = [], 0.0
    for i in range(300):
        at += rng.choice([0, 1, 5, 40, 200])
        rows.append(event(f"r{i:03d}", acct(f"S{rng.randrange(4)}"), acct(f"D{rng.randrange(9)}"), at=at - rng.choice([0, 0, 10, 80, 500]), arrival=at,
                          device=rng.choice([None, "", "dev-a"])))
    cfgs = (FO, SD, RuleConfig("FAN_IN", 600, 0, 2))
    act = activity(events(rows), cfgs)
    late = {(r.rule_type, r.event_id) for r in rules.late_events(act, cfgs).collect()}
    kept = rules.on_time(act, cfgs)
    taken = {(r.rule_type, r.event_id) for r in kept.collect()}
    assert late and not late & taken and late | taken == {(r.rule_type, r.event_id) for r in act.collect()}
    p = kept._jdf.queryExecution().toString()
    assert "Window" not in p.split("== Physical Plan ==")[1] and "hashpartitioning" not in p


def test_candidates_are_the_same_with_ids_that_are_uuids(events):
    """UUIDs travel as bytes; other texts, and a mix, as they are."""
    def of(name):
        rows = [event(name(f"e{i}"), acct("A"), acct(f"D{i % 6}"), at=i, tx=name(f"t{i}"), device="é-dev", ip="ip") for i in range(8)]
        rows += [event(name(f"f{i}"), acct(f"S{i}"), acct("B"), at=i, tx=name(f"u{i}"), device="é-dev", ip="ip") for i in range(3)]
        cfgs = (FO, FI, SD, SI)
        got = {c.deduplication_key: c for c in rules.candidates(events(rows), cfgs).collect()}
        flat = {(k, e.kind, e.value) for k in got for e in rules.evidence(events(rows), cfgs).where(F.col("deduplication_key") == k).collect()}
        assert flat == {(k, "account", a) for k, c in got.items() for a in c.involved_accounts} | {
            (k, "transaction", t) for k, c in got.items() for t in c.transaction_ids}
        fired = rules.firing(activity(events(rows), cfgs), cfgs).collect()
        assert {(f.deduplication_key, f.generated_at, f.trigger_event_id, f.primary_account_id) for f in fired} == {
            (k, c.generated_at, c.trigger_event_id, c.primary_account_id) for k, c in got.items()}
        return {k: (c.distinct_accounts_count, c.transaction_count, sorted(c.involved_accounts), set(c.transaction_ids), c.trigger_event_id) for k, c in got.items()}

    plain, packed, mixed = of(str), of(acct), of(lambda x: acct(x) if x.endswith("1") else x)
    assert set(plain) == set(packed) == set(mixed) and any("é-dev" in k for k in plain)
    fan = next(k for k in plain if k.startswith("FAN_OUT"))
    assert plain[fan][3] == {f"t{i}" for i in range(5)} and packed[fan][3] == {acct(f"t{i}") for i in range(5)}
    assert plain[fan][4] == "e4" and packed[fan][4] == acct("e4") and plain[fan][:3] == packed[fan][:3] == mixed[fan][:3]
