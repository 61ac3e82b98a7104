"""Cycle search on random graphs equals a depth-first search that follows the
reference's pattern literally: simple paths d -> ... -> s of 1..max_depth-1
edges over the graph as it stood when the candidate arrived."""

import datetime as dt
import random

import pytest

from conftest import T0, acct, event
from flowwatch.config import CycleConfig
from flowwatch.operators import cycles


def edge_state(rows, before):
    """Edges built from events that arrived strictly before ``before``."""
    state = {}
    for r in sorted(rows, key=lambda r: (r[11], r[0])):
        if (r[11], r[0]) >= before:
            break
        k = (r[4], r[5], r[7])
        e = state.setdefault(k, {"total": 0, "occ": None, "tx": None})
        e["total"] += r[6]
        if e["occ"] is None or r[10] > e["occ"]:
            e["occ"], e["tx"] = r[10], r[1]
    return state


def dfs_paths(rows, cfg):
    out = set()
    for c in rows:
        s, d, x, t = c[4], c[5], c[6], c[10]
        slack = x * cfg.tolerance_percent // 100
        lo, hi, tmin = x - slack, x + slack, t - dt.timedelta(seconds=cfg.window_seconds)
        adj = {}
        for (src, dst, cur), e in edge_state(rows, (c[11], c[0])).items():
            if lo <= e["total"] <= hi and tmin <= e["occ"] <= t:
                adj.setdefault(src, []).append((dst, cur, e))

        def walk(node, nodes, txs, curs, prev):
            for dst, cur, e in adj.get(node, []):
                if prev is not None and e["occ"] < prev:
                    continue
                if dst == s:
                    out.add((c[0], tuple(nodes + [dst]), tuple(txs + [e["tx"]]), tuple(curs + [cur])))
                elif dst not in nodes and len(nodes) < cfg.max_depth - 1:
                    walk(dst, nodes + [dst], txs + [e["tx"]], curs + [cur], e["occ"])
        walk(d, [d], [], [], None)
    return out


@pytest.mark.parametrize("seed,cfg", [(11, CycleConfig(4, 3600, 20)), (12, CycleConfig(3, 7200, 50)),
                                      (13, CycleConfig(5, 1800, 30))])
def test_circular_flow_matches_dfs(events, seed, cfg):
    rnd = random.Random(seed)
    nodes = [acct(f"N{i}") for i in range(9)]
    rows = []
    for i in range(140):
        a, b = rnd.sample(nodes, 2)
        at = rnd.randrange(0, 7200)
        rows.append(event(f"e{i:03d}", a, b, amount=rnd.choice([900, 1000, 1100, 1250]), at=at,
                          arrival=at + rnd.randrange(0, 300), currency=rnd.choice(["USD", "EUR"])))
    want = dfs_paths(rows, cfg)
    rows_out = [(r.cand_event_id, tuple(r.path_accounts), tuple(r.path_transactions), tuple(r.path_currencies))
                for r in cycles.circular_flow(events(rows), cfg).collect()]
    assert len(rows_out) == len(set(rows_out))          # each path exactly once (bucket explode is exact)
    assert set(rows_out) == want and len(want) > 10
