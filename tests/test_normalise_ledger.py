from conftest import acct, event
from flowwatch.operators import ledger, normalise


def reasons(events, rows):
    return {r.event_id: r.failure_reason for r in normalise.classify(events(rows)).collect()}


def test_valid_and_reasons(events):
    rows = [event("ok", acct("A"), acct("B")),
            event("neg", acct("A"), acct("B"), amount=-100),
            event("same", acct("A"), acct("A")),
            event("nullamt", acct("A"), acct("B"), amount=None),
            event("cur", acct("A"), acct("B"), currency="US"),
            event("ver", acct("A"), acct("B"), version=2),
            event("nullver", acct("A"), acct("B"), version=None),
            event("time", acct("A"), acct("B"), at=None)]
    rows[-1] = rows[-1][:10] + (None, rows[0][11])
    r = reasons(events, rows)
    assert r == {"ok": None, "neg": "Amount must be positive", "same": "Source equals destination",
                 "nullamt": "Amount must be positive", "cur": "Invalid currency format",
                 "ver": "Unsupported schema version", "nullver": "Unsupported schema version",
                 "time": "Missing timestamps"}


def test_reason_precedence(events):
    row = ("e", None, 2, "c", None, None, 0, "x", None, None, None, None)
    assert reasons(events, [row]) == {"e": "Missing IDs"}


def test_split_partitions_input(events):
    rows = [event(f"e{i}", acct("A"), acct("B") if i % 3 else acct("A")) for i in range(9)]
    raw = events(rows)
    assert normalise.validated(raw).count() + normalise.invalid(raw).count() == 9


def test_ledger_replay_conflict_nulls(events):
    rows = [event("e1", acct("A"), acct("B"), tx="t1", arrival=0),
            event("e1", acct("A"), acct("B"), tx="t1", arrival=10),          # replay
            event("e2", acct("A"), acct("B"), tx="t1", arrival=20),          # conflict
            event("e3", acct("A"), acct("C"), tx="t2", device=None, ip=None)]
    v = events(rows)
    led = {r.transaction_id: r for r in ledger.ledger(v).collect()}
    assert set(led) == {"t1", "t2"} and led["t1"].event_id == "e1"
    assert led["t2"].device_id is None and led["t2"].ip_hash is None
    assert [r.event_id for r in ledger.replays(v).collect()] == ["e1"]
    conf = ledger.conflicts(v).collect()
    assert [(r.event_id, r.winner_event_id) for r in conf] == [("e2", "e1")]
    assert conf[0].error == "Conflicting identity or payload for transaction t1"


def test_ledger_event_id_reuse_and_long_text(events):
    rows = [event("e1", acct("A"), acct("B"), tx="t1", arrival=0),
            event("e1", acct("A"), acct("B"), tx="t9", arrival=5),           # same event id, other tx
            event("e4", acct("A"), acct("B"), tx="t4", device="d" * 256)]
    v = events(rows)
    assert {r.transaction_id for r in ledger.ledger(v).collect()} == {"t1"}
    rej = {r.transaction_id: r.error for r in ledger.constraint_rejects(v).collect()}
    assert rej["t9"].startswith("event_id already used") and rej["t4"].startswith("device_id or ip_hash")


def test_ledger_lookup(events):
    rows = [event(f"e{i}", acct("A"), acct("B"), at=i * 3600) for i in range(5)]
    led = ledger.ledger(events(rows))
    from conftest import T0
    import datetime as dt
    got = ledger.lookup(led, "source", acct("A"), T0, T0 + dt.timedelta(hours=2)).count()
    assert got == 2


def test_lookup_copies_move_narrow_rows_of_one_written_ledger(spark, events, tmp_path):
    """The copies are cut from the written ledger, UUIDs as bytes on the way; texts of any kind come back."""
    for name in (acct, str):
        rows = [event(name(f"e{i}"), acct(f"A{i % 3}"), acct(f"B{i % 4}"), at=i, tx=name(f"t{i}"), device=["", "d", None][i % 3]) for i in range(20)]
        whole = ledger.ledger(events(rows))
        copies = ledger.index_rows(whole, 4)
        p = copies._jdf.queryExecution().executedPlan().toString()
        assert "min_by" not in p and "/kept/ledger-" in p
        at = str(tmp_path / name.__name__)
        copies.write.partitionBy(*ledger.INDEX_PARTS).parquet(at)
        index = spark.read.parquet(at)
        for by, column in ledger.LOOKUP_COLUMNS.items():
            got = index.where(f"lookup = '{by}'")
            assert got.where(f"key <=> {column}").count() == got.count()
            assert sorted(map(repr, got.select(whole.columns).collect())) == sorted(map(repr, whole.where(f"{column} is not null").collect()))
