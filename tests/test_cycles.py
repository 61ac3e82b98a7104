from conftest import acct, event
from pyspark.sql import functions as F

from flowwatch.config import CycleConfig
from flowwatch.operators import cycles

H = 3600
CFG = CycleConfig(4, 86400, 10)


def paths(events, rows, cfg=CFG, snapshot=False):
    fn = cycles.circular_flow_snapshot if snapshot else cycles.circular_flow
    return fn(events(rows), cfg, prefilter_edges=False).collect()


def closing(rows, p):
    return [r for r in p if r.cand_event_id == rows[-1][0]]


def test_three_cycle_found(events):
    A, B, C = acct("A"), acct("B"), acct("C")
    rows = [event("ab", A, B, at=-2 * H), event("bc", B, C, at=-1 * H), event("ca", C, A, at=0)]
    p = paths(events, rows)
    assert len(p) == 1 and p[0].primary_account_id == C and p[0].path_accounts == [A, B, C]
    al = cycles.circular_alerts(cycles.circular_flow(events(rows), CFG)).collect()
    assert al[0].deduplication_key == "CIRCULAR_FLOW_" + "_".join(sorted([A, B, C]))
    assert sorted(al[0].transaction_ids) == sorted(["tx-ab", "tx-bc", "tx-ca"])


def test_two_and_four_cycles_five_not(events):
    n = [acct(f"N{i}") for i in range(5)]
    two = [event("x", n[0], n[1], at=-10), event("y", n[1], n[0], at=0)]
    assert [r.depth for r in paths(events, two)] == [1]
    four = [event(f"f{i}", n[i], n[(i + 1) % 4], at=i * 10) for i in range(4)]
    assert [r.depth for r in closing(four, paths(events, four))] == [3]
    five = [event(f"g{i}", n[i], n[(i + 1) % 5], at=i * 10) for i in range(5)]
    assert closing(five, paths(events, five)) == []


def test_time_bounds_and_order(events):
    A, B, C = acct("A"), acct("B"), acct("C")
    old = [event("ab", A, B, at=-86401), event("bc", B, C, at=-10), event("ca", C, A, at=0)]
    assert closing(old, paths(events, old)) == []
    edge = [event("ab", A, B, at=-86400), event("bc", B, C, at=-10), event("ca", C, A, at=0)]
    assert len(closing(edge, paths(events, edge))) == 1
    wrong = [event("ab", A, B, at=-10, arrival=-100), event("bc", B, C, at=-20, arrival=-90),
             event("ca", C, A, at=0)]
    assert closing(wrong, paths(events, wrong)) == []
    equal = [event("ab", A, B, at=-10), event("bc", B, C, at=-10), event("ca", C, A, at=0)]
    assert len(closing(equal, paths(events, equal))) == 1


def test_amount_tolerance_boundaries(events):
    A, B, C = acct("A"), acct("B"), acct("C")
    for amt, found in ((900, True), (1100, True), (899, False), (1101, False)):
        rows = [event("ab", A, B, amount=amt, at=-20), event("bc", B, C, at=-10), event("ca", C, A, at=0)]
        assert bool(closing(rows, paths(events, rows))) == found, amt


def test_mixed_currency_and_as_of(events):
    A, B, C = acct("A"), acct("B"), acct("C")
    rows = [event("ab", A, B, at=-20, currency="EUR"), event("bc", B, C, at=-10), event("ca", C, A, at=0)]
    assert len(closing(rows, paths(events, rows))) == 1
    # closing edge arrives before B->C: not found as of arrival, found in the final graph
    late = [event("ab", A, B, at=-20, arrival=0), event("ca", C, A, at=0, arrival=1),
            event("bc", B, C, at=-10, arrival=2)]
    assert [r for r in paths(events, late) if r.cand_event_id == "ca"] == []
    assert [r for r in paths(events, late, snapshot=True) if r.cand_event_id == "ca"] != []


def test_prefilter_keeps_cycle_edges(events):
    A, B, C, D = acct("A"), acct("B"), acct("C"), acct("D")
    rows = [event("ab", A, B, at=-20), event("bc", B, C, at=-10), event("ca", C, A, at=0),
            event("ad", A, D, at=0)]
    from flowwatch.operators import graph
    ev = events(rows)
    kept = {(r.src, r.dst) for r in cycles.prefilter(graph.edges(graph.processed(ev)), ev, CFG).collect()}
    assert kept == {(A, B), (B, C), (C, A)}


def test_trimming_goes_on_to_a_fixed_point(events):
    """A long dead-end chain vanishes from both its ends, with the candidates on it; edges out of time or amount do too."""
    from flowwatch.operators import graph
    A, B = acct("A"), acct("B")
    chain = [acct(f"K{i}") for i in range(14)]
    rows = [event(f"k{i}", chain[i], chain[i + 1], at=i) for i in range(13)]
    rows += [event("in", A, chain[0], at=-1), event("ab", A, B, at=0), event("ba", B, A, at=5)]
    rows += [event("far", B, A, currency="EUR", amount=10 ** 6, at=6), event("old", A, B, currency="EUR", at=-40 * 86400)]
    ev = events(rows)
    edges = graph.edges(graph.processed(ev))
    cands = cycles.cycle_candidates(ev, CFG)
    kept, left = cycles.trim(edges, cands, CFG, max_rounds=20)
    assert {(r.src, r.dst, r.currency) for r in kept.collect()} == {(A, B, "USD"), (B, A, "USD")}
    assert {r.cand_event_id for r in left.collect()} <= {"ab", "ba"}
    once = cycles.trim(edges, cands, CFG, max_rounds=1)[0].count()
    assert 2 < once < edges.count()


def test_lighter_end_is_extended(events):
    """A hub with many payees: the search from a payer's side makes no pair of payer and payee."""
    hub, n = acct("HUB"), 60
    rows = [event(f"i{k}", acct(f"I{k}"), hub, at=k) for k in range(n)]
    rows += [event(f"o{k}", hub, acct(f"O{k}"), at=100 + k) for k in range(n)]
    rows += [event(f"b{k}", acct(f"O{k}"), acct(f"I{k}"), at=200 + k) for k in range(0, n, 10)]
    rows += [event(f"c{k}", acct(f"I{k}"), hub, at=300 + k, currency="EUR") for k in range(0, n, 10)]
    from flowwatch.operators import graph
    ev = events(rows)
    versions = graph.edge_versions(graph.processed(ev))
    edges, out, into = cycles.with_degrees(cycles.edge_view(versions, CFG, True))
    frontier = cycles._open_ends(cycles.cycle_candidates(ev, CFG), out, into)
    assert cycles._grown(frontier, edges, CFG, True).count() < 10 * n
    found = paths(events, rows)
    assert {(r.cand_event_id, r.depth) for r in found} == {(f"{c}{k}", 2) for c in "bc" for k in range(0, n, 10)}


def test_busy_edge_meets_versions_of_its_time_only(events):
    """One edge with a version per second: a candidate meets the few that were valid around its arrival."""
    from flowwatch.operators import graph
    A, B = acct("A"), acct("B")
    cfg = CycleConfig(3, 86400, 50)
    rows = [event(f"v{k:05d}", A, B, amount=1, at=k) for k in range(4000)]
    rows += [event(f"z{k}", B, A, amount=500 * k, at=500 * k + 0.5) for k in range(1, 8)]
    ev = events(rows)
    versions = graph.edge_versions(graph.processed(ev))
    edges, out, into = cycles.with_degrees(cycles.edge_view(versions, cfg, True))
    frontier = cycles._open_ends(cycles.cycle_candidates(ev, cfg).where("cand_event_id like 'z%'"), out, into)
    met = (frontier.withColumn("_l", F.explode("tail_levels"))
           .withColumn("_s", F.when(F.col("_l") == 0, F.lit(0).cast("long")).otherwise(
               F.floor(F.unix_micros(F.col("arr.ts")) / cycles._slot_width("_l")))).alias("f")
           .join(edges, (F.col("tail") == F.col("e_src")) & (F.col("_l") == F.col("e_level")) & (F.col("_s") == F.col("e_slot"))))
    assert met.count() <= 7 * 4                               # of 4000 versions
    got = {(r.cand_event_id, tuple(r.path_transactions)) for r in paths(events, rows, cfg) if r.cand_event_id.startswith("z")}
    assert got == {(f"z{k}", (f"tx-v{500 * k:05d}",)) for k in range(1, 8)}


def test_hub_meets_only_edges_of_its_amounts(events):
    """Payments into and out of a hub lie in different amount bands: the join makes no pairs."""
    hub = acct("HUB")
    rows = [event(f"i{k}", acct(f"I{k}"), hub, amount=4 ** (k % 8) * 10, at=k) for k in range(16)]
    rows += [event(f"o{k}", hub, acct(f"O{k}"), amount=4 ** (k % 8) * 20, at=20 + k) for k in range(16)]
    cand = cycles.cycle_candidates(events(rows), CFG)
    assert max(len(r.bands) for r in cand.select("bands").collect()) <= 2
    assert paths(events, rows) == []
    for tol in (0, 10, 59, 100, 250):
        cfg = CycleConfig(3, 86400, tol)
        two = [event("x", acct("A"), acct("B"), amount=1000, at=0), event("y", acct("B"), acct("A"), amount=1000, at=9)]
        assert len(paths(events, two, cfg)) == 1, tol


def test_versions_of_all_lifetimes_have_few_levels(events):
    """A frontier row is looked up once per level: versions that live a second to three days lie in seven."""
    from flowwatch.operators import graph
    A = acct("A")
    cfg = CycleConfig(4, 259200, 50)
    rows = [event(f"v{k}{i}", A, acct(f"B{k}"), at=0, arrival=i * 2 ** k) for k in range(18) for i in range(2)]
    versions = graph.edge_versions(graph.processed(events(rows)))
    out = cycles.with_degrees(cycles.edge_view(versions, cfg, True))[1]
    assert max(len(r.e_out_levels) for r in out.collect()) <= 7


def test_uuid_ids_travel_as_bytes_and_come_back(events):
    """Paths are the same with ids that are UUIDs, that are not, and that are in part."""
    n = [acct(f"N{i}") for i in range(4)]
    at = [(0, 1, -30), (1, 2, -20), (2, 3, -10), (3, 0, 0), (1, 0, 5)]

    def rows(name):
        return [event(name(f"e{i}"), n[a], n[b], at=t, tx=name(f"t{i}")) for i, (a, b, t) in enumerate(at)]
    want = {(("e3",), ("t0", "t1", "t2")), (("e4",), ("t0",))}
    for name in (str, acct, lambda x: acct(x) if x.endswith("1") else x, lambda x: acct(x).upper()):
        got = {((r.cand_event_id,), tuple(r.path_transactions)) for r in cycles.circular_flow(events(rows(name)), CFG).collect()}
        assert got == {((name(e),), tuple(map(name, t))) for (e,), t in want}


def test_trimming_masks_equal_plain_neighbours(events):
    """Trimming by bit masks (several words of bands at a small tolerance) equals a plain search for neighbours."""
    import random

    from flowwatch.operators import graph
    rng = random.Random(5)
    n = [acct(f"M{i}") for i in range(6)]
    for tol in (0, 10, 50):
        cfg = CycleConfig(4, 86400, tol)
        rows = [event(f"m{i}", *rng.sample(n, 2), amount=int(10 ** rng.uniform(0, 4)), at=rng.randrange(4 * 86400)) for i in range(150)]
        ev = events(rows)
        edges, cands = graph.edges(graph.processed(ev)), cycles.cycle_candidates(ev, cfg)
        band, bucket = (lambda c: cycles._band(F.col(c), cfg)), (lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (86400 * 10 ** 6)))
        t = {(True, r.src, r.dst, r.u, r.b) for r in edges.select("src", "dst", bucket("latest_occurred_at").alias("u"), band("total_amount_minor").alias("b")).collect()}
        t |= {(False, r.cs, r.cd, r.u, r.bands[0]) for r in cands.select("cs", "cd", bucket("t").alias("u"), "bands").collect()}

        def near(r, x, ahead):
            d = x[3] - r[3] if ahead else r[3] - x[3]
            if r[0] and x[0]:
                return d in (0, 1) and abs(x[4] - r[4]) <= 2
            if r[0]:
                return x[3] - r[3] in (0, 1) and r[4] - x[4] in (0, 1, 2)
            return x[0] and r[3] - x[3] in (0, 1) and x[4] - r[4] in (0, 1, 2)
        for _ in range(2):
            t = {r for r in t if any(x[1] == r[2] and near(r, x, True) for x in t) and any(x[2] == r[1] and near(r, x, False) for x in t)}
        kept, left = cycles.trim(edges, cands, cfg, 2, -1.0)
        got = kept.select("src", "dst", bucket("latest_occurred_at").alias("u"), band("total_amount_minor").alias("b")).distinct().collect()
        assert {tuple(r) for r in got} == {r[1:] for r in t if r[0]}
        got = left.select("cs", "cd", bucket("t").alias("u"), F.get("bands", F.lit(0)).alias("b")).distinct().collect()
        assert {tuple(r) for r in got} == {r[1:] for r in t if not r[0]}
