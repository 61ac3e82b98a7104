"""Cases that an earlier version got wrong: rewritten inputs, redeliveries, null correlation ids, wide amounts, deep cycles."""

import pytest

from flowwatch.config import CycleConfig
from flowwatch.operators import activity, cycles, ledger
from flowwatch.session import checkpoint_dir
from flowwatch.sources.staging import staged

from conftest import event


def test_staged_table_follows_a_rewritten_input(spark, tmp_path):
    def count():
        path = f"{tmp_path}/events.parquet"
        return staged(spark, "rewritten", str(tmp_path), lambda: spark.read.parquet(path)).count()

    spark.range(5).write.parquet(f"{tmp_path}/events.parquet")
    assert count() == 5 and count() == 5
    spark.range(11).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert count() == 11


def test_checkpoint_dir_is_required_off_local_masters():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://somewhere:7077"})()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def test_identical_redelivery_is_one_replay(events):
    rows = [event("e1", "a", "b")] * 3 + [event("e2", "a", "c")]
    assert ledger.replays(events(rows)).count() == 2


def test_null_correlation_id_reaches_the_graph(events):
    row = list(event("e1", "a", "b"))
    row[3] = None
    bad = list(event("e2", "a", "b"))
    bad[3] = "not-a-uuid"
    df = events([tuple(row), tuple(bad)])
    assert [r.event_id for r in activity.graph_updates(df).collect()] == ["e1"]
    assert [r.event_id for r in activity.graph_update_failures(df).collect()] == ["e2"]


def test_wide_amounts_keep_their_bounds(events):
    df = events([event("e1", "a", "b", amount=4 * 10**18)])
    r = cycles.cycle_candidates(df, CycleConfig(4, 86400, 300)).first()
    assert (r.lo, r.hi) == (4 * 10**18 - 12 * 10**18, 16 * 10**18)


def test_depth_has_no_upper_bound():
    assert CycleConfig(max_depth=7).max_depth == 7
