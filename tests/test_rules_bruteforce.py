"""First-crossing on skewed, shuffled data equals a plain fold in arrival order."""

import datetime as dt
import random

import pytest

from conftest import T0, acct, event
from flowwatch.config import RuleConfig
from flowwatch.operators import rules


def brute_force(rows, cfg, drop_late):
    """The per-event state update, group by group, in arrival order; a closed window takes no more rows."""
    key_idx, cp_idx = {"FAN_OUT": (4, 5), "FAN_IN": (5, 4)}[cfg.rule_type]
    groups, stream_time = {}, 0
    for r in sorted(rows, key=lambda r: (r[11], r[0])):
        at = int(r[10].replace(tzinfo=dt.timezone.utc).timestamp())
        w = at // cfg.window_seconds
        closed = (w + 1) * cfg.window_seconds + cfg.grace_seconds <= stream_time
        stream_time = max(stream_time, at)
        if closed and drop_late:
            continue
        groups.setdefault((r[key_idx], r[7], w), []).append(r)
    out = {}
    for g, evs in groups.items():
        cps, txs, n, amt = set(), set(), 0, 0
        for r in evs:
            cps.add(r[cp_idx]); txs.add(r[1]); n += 1; amt += r[6]
            if len(cps) >= cfg.min_distinct and (cfg.min_count <= 0 or n >= cfg.min_count) \
                    and (cfg.min_amount <= 0 or amt >= cfg.min_amount):
                out[g] = (r[0], len(cps), n, amt, tuple(sorted(cps)), tuple(sorted(txs)))
                break
    return out


@pytest.mark.parametrize("drop_late", [True, False])
@pytest.mark.parametrize("seed,cfg", [
    (1, RuleConfig("FAN_OUT", 60, 15, 4)),
    (2, RuleConfig("FAN_OUT", 60, 15, 3, min_count=6)),
    (3, RuleConfig("FAN_OUT", 120, 15, 3, min_amount=2500)),
    (4, RuleConfig("FAN_IN", 60, 15, 3, min_count=4, min_amount=1500)),
])
def test_first_crossing_matches_fold(events, seed, cfg, drop_late):
    rnd = random.Random(seed)
    rows = []
    for i in range(600):
        hot = rnd.random() < 1 / 3                          # one key holds a third of the rows
        src = acct("HOT") if hot else acct(f"S{rnd.randrange(40)}")
        dst = acct(f"D{rnd.randrange(12)}")
        if src == dst:
            continue
        at = rnd.randrange(0, 600)
        arrival = at + rnd.randrange(0, 90)                 # arrival order differs from event order
        rows.append(event(f"e{i:04d}", src, dst, amount=rnd.randrange(50, 900), at=at, arrival=arrival,
                          currency=rnd.choice(["USD", "USD", "EUR"])))
    rows += rnd.sample(rows, 60) + rnd.sample(rows, 20)     # delivered again, unchanged
    want = brute_force(rows, cfg, drop_late)
    got = {}
    for c in rules.candidates(events(rows), (cfg,), drop_late=drop_late).collect():
        key = c.primary_account_id
        w = int(c.window_start.replace(tzinfo=dt.timezone.utc).timestamp()) // cfg.window_seconds
        got[(key, c.currency, w)] = (c.trigger_event_id, c.distinct_accounts_count, c.transaction_count,
                                     c.total_amount_minor, tuple(c.involved_accounts), tuple(c.transaction_ids))
    assert got == want and len(want) > 5
