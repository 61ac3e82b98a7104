"""Room on disk: what a job writes on the way goes when it has been used, and joins copy a row only for keys that some edge has."""

import os
import time

import pytest
from conftest import acct, event
from pyspark.sql import functions as F

from flowwatch.config import CycleConfig
from flowwatch.operators import cycles
from flowwatch.session import SESSION_DEFAULTS, checkpoint_dir, is_kept, kept, release, scratch

CFG = CycleConfig(4, 86400, 10)


def shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.length())) if name.startswith("shuffle_")}


def kept_folders(spark) -> set[str]:
    at = os.path.join(checkpoint_dir(spark), "kept")
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_shuffle_files_of_a_kept_frame_go_with_its_write(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, value = shuffle_files(spark), spark.conf.get(setting, None)
    out = kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "room")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(setting, None) == value               # other jobs of the session keep theirs
    assert sorted(r["count"] for r in out.collect()) == [142] + [143] * 6


def test_release_and_outlive(spark):
    with scratch():
        with scratch():
            inner, result = kept(spark.range(3), "room-in"), kept(spark.range(4), "room-out", outlive=True)
            gone = kept(spark.range(5), "room-gone")
            assert is_kept(gone) and not is_kept(spark.range(1))
            release(gone)
            assert not [f for f in kept_folders(spark) if f.startswith("room-gone")] and inner.count() == 3
        assert not [f for f in kept_folders(spark) if f.startswith("room-in")] and result.count() == 4
    assert not [f for f in kept_folders(spark) if f.startswith("room-out")]


def triangle():
    a, b, c = acct("A"), acct("B"), acct("C")
    return [event("ab", a, b, at=-200), event("bc", b, c, at=-100), event("ca", c, a, at=0)]


@pytest.mark.parametrize("search", [cycles.circular_flow, cycles.circular_flow_snapshot])
def test_only_the_paths_of_a_search_stay(spark, events, search):
    before = kept_folders(spark)
    found = search(events(triangle()), CFG)
    assert {f.rsplit("-", 1)[0] for f in kept_folders(spark) - before} == {"cycle-paths"}
    assert "ca" in {r.cand_event_id for r in found.collect()}


def test_what_trimming_keeps_is_gone_when_frontiers_grow(spark, events, monkeypatch):
    before, seen, grown = kept_folders(spark), [], cycles._grown_parts

    def watched(*args):
        seen.append(sorted(f.rsplit("-", 1)[0] for f in kept_folders(spark) - before))
        return grown(*args)

    monkeypatch.setattr(cycles, "_grown_parts", watched)
    assert "ca" in {r.cand_event_id for r in cycles.circular_flow(events(triangle()), CFG).collect()}
    assert seen[0] == ["cycle"] * 3 + ["cycle-paths"]           # edges, their keys and the frontier


def test_frontier_rows_keep_only_keys_that_an_edge_has(spark, events):
    d, e = acct("D"), acct("E")
    rows = events(triangle() + [event("de", d, e, at=0), event("ed", e, d, amount=10**9, at=1)])
    versions = cycles.graph.edge_versions(cycles.graph.processed(rows))
    edges, out, into = cycles.with_degrees(cycles.edge_view(versions, CFG, True))
    cands = cycles.cycle_candidates(rows, CFG)
    keys = cycles._edge_keys(edges, True)
    frontier = cycles._met([cycles._open_ends(cands, out, into)], keys, CFG, True, True)
    met = {r.cand_transaction_id: r for r in frontier.collect()}
    assert "tx-ca" in met and "tx-ed" not in met and "tx-de" not in met        # no edge near the amounts of these two
    had = {k._k for k in keys.collect()}
    assert all(set(r._keys) <= had for r in met.values())
    copies = cycles._copies(frontier, CFG, True, cycles._AHEAD)
    assert copies.where(F.array_contains("_keys", F.col("_k"))).count() < copies.count()


def test_tables_are_written_in_small_row_groups(spark):
    import pyarrow.parquet as pq

    wide = kept(spark.range(600_000, numPartitions=1).select(*[F.sha2(F.concat(F.lit(str(n)), F.col("id").cast("string")), 256).alias(f"c{n}") for n in range(2)]), "room-wide")
    files = [f.removeprefix("file://").removeprefix("file:") for f in wide.inputFiles()]
    groups = [pq.ParquetFile(f).metadata.row_group(g).total_byte_size for f in files for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > 1 and max(groups) < 72 << 20
    assert int(SESSION_DEFAULTS["spark.sql.files.maxPartitionBytes"].removesuffix("m")) <= 32
