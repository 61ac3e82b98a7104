"""Operators 11 to 13: brute force, odd rows, empty tables; the registered queries against their SQL."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from flowwatch.llm import catalog, centroids, repair, sql, urlfilter

SF = "/root/testdata/sf0.001"
VECTOR = "vec_id long, embedding array<double>, label int, cluster string"


@pytest.mark.parametrize("name", ["op11_centroids", "op12_conversation_repair", "op13_url_filter"])
def test_query_equals_sql(llm_spark, name):
    found = catalog.queries()[name](llm_spark, SF)
    con = duckdb.connect()
    for table in ("embeddings", "conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(sql.ORACLE[name])
    names = sorted(d[0] for d in result.description)
    order = [[d[0] for d in result.description].index(n) for n in names]
    assert names == sorted(found.columns)
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr) == sorted(
        (tuple(r[i] for i in order) for r in result.fetchall()), key=repr)


# ---------------------------------------------------------------- 11

def lloyd(rows, cfg):
    """Plain rounds over whole vectors with Python's own integers."""
    kept = [(i, [int(np.floor(cfg.scale * x)) for x in v]) for i, v in rows]
    named = sorted((hashlib.sha256(f"{cfg.start}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in named[:cfg.k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(cfg.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), cents


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(2)
    base = rng.integers(-300, 300, (40, 16))
    rows = base[rng.integers(0, 40, 500)]
    rows[:100, 3] = rng.integers(-9, 9, 100)
    for data in (rows, rng.integers(-2, 2, (300, 16)), rows[:1]):
        width, entries, codes = centroids.encode(data, 4)
        assert (np.hstack([e[c] for e, c in zip(entries, codes)]) == data).all()
        chunk = centroids.Chunk(width, [len(e) for e in entries], np.vstack(entries).astype(np.int32).tobytes(),
                                codes.astype(np.uint16).tobytes(), len(data))
        cents = rng.integers(-300, 300, (4, 16))
        plain = ((data[:, None] - cents) ** 2).sum(-1)
        assert (chunk.distances(cents) == plain).all()
        label = plain.argmin(1)
        assert (chunk.sums(label, 4) == np.array([data[label == c].sum(0) for c in range(4)])).all()
    assert centroids.encode(rows, 4)[0] > 1                # copies make wide blocks worth it


def test_clusters_equal_plain_rounds(llm_spark):
    rng = random.Random(5)
    cfg = centroids.ClusterConfig(k=5, rounds=4, dims=6, chunk_rows=16)
    hot = [0.25] * 6
    rows = [(i, hot if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(6)]) for i in range(150)]
    rows += [(7, [0.5] * 6), (7, [0.5] * 6), (None, [-0.5] * 6)]
    odd = [(900, None), (901, []), (902, [1.0] * 5), (903, [None] + [1.0] * 5), (904, [float("nan")] * 6), (905, [float("inf")] * 6)]
    df = llm_spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], VECTOR)
    found, cents = centroids.cluster(df, cfg)
    want, plain = lloyd(rows, cfg)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert cents.tolist() == plain
    full = centroids.with_inertia(found, cents).collect()
    assert {r.inertia for r in full} == {sum(w[2] for w in want)}
    for r in full:
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, plain[r.cluster])).encode()).hexdigest()


def test_few_and_extreme_vectors(llm_spark):
    cfg = centroids.ClusterConfig(k=8, rounds=2, dims=3)
    none, cents = centroids.cluster(llm_spark.createDataFrame([], VECTOR), cfg)
    assert none.count() == 0 and len(cents) == 0 and centroids.with_inertia(none, cents).count() == 0
    df = llm_spark.createDataFrame([(1, [1e300, -1e300, 0.0], 1, "x"), (2, [-0.001, 0.0, 0.0], 1, "x")], VECTOR)
    found, _ = centroids.cluster(df, cfg)
    assert sorted(r.distance for r in found.collect()) == [0, 0]


# ---------------------------------------------------------------- 12

def shortest(rows):
    """Best (cost, audit) by trying every edit row by row; up to two inserts before each row and at the end."""
    def inserts(labels):
        out = dict(labels)
        for _ in range(2):
            for s, (cost, audit) in list(out.items()):
                t = repair.NEXT[s][1]
                out[t] = min(out.get(t, (10 ** 9, "")), (cost + 3, audit + "I"))
        return out

    labels = {0: (0, "")}
    for initial, fault in rows:
        made = {}
        for s, (cost, audit) in inserts(labels).items():
            ways = [(s, cost + 4, "D")]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                ways.append((repair.NEXT[s][1], cost + 3 + extra, "R"))
                if (s, initial) in repair.STEP:
                    ways.append((repair.STEP[s, initial], cost + extra, "K"))
            for t, c, letter in ways:
                made[t] = min(made.get(t, (10 ** 9, "")), (c, audit + letter))
        labels = made
    labels = inserts(labels)
    return min(labels[s] for s in (0, 3) if s in labels)


def judged(rows):
    """The contract's columns of one conversation's rows."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=key)
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = shortest([(r[1][:1], f) for r, f in zip(rows, faults)])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    lines = "\n".join(repair.repaired(audit, ((r[1], r[2]) for r in rows)))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256(lines.encode()).hexdigest())


def test_search_finds_the_least_audit():
    rng = random.Random(3)
    for _ in range(3000):
        rows = [(rng.choice(["s", "u", "a", "x", ""]), rng.choice(["", "", "truncated", "duplicate"])) for _ in range(rng.randint(0, 8))]
        items = []
        for initial, fault in rows:
            if fault != "duplicate":
                items.append((initial, fault == "truncated"))
            elif items and isinstance(items[-1], int):
                items[-1] += 1
            else:
                items.append(1)
        want = shortest(rows)
        assert repair.cheapest(tuple(items), 0, repair.ACCEPTED) == want
        cut = rng.randint(0, len(items))                   # pieces fold to the same
        labels = repair.fold(repair.fold({0: (0, "")}, repair.ways(tuple(items[:cut]))), repair.ways(tuple(items[cut:])))
        assert min(labels[s] for s in repair.ACCEPTED if s in labels) == want


TALK = "conv_id long, turn long, role string, text string, cost string"


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), rng.choice(["system", "user", "assistant", "tool", "", None]),
                         rng.choice(["Hi.", "Hi", "", " \n", "One more!", "Ünd?", None, f"row {turn}.", "x" * 5000])))
    rows += [(50, turn, ("user", "assistant")[turn % 2], f"text {turn}.") for turn in range(900)]      # long, over several ranges
    rows += [(50, 7, "user", "again.")] * 300 + [(50, None, "system", "You help.")] * 4
    rows += [(51, None, None, None)] * 3
    return rows


@pytest.mark.parametrize("piece_items", [3, 256])
def test_repair_equals_plain_search(llm_spark, talks, piece_items):
    df = llm_spark.createDataFrame([(*r, "x") for r in talks], TALK).repartition(5)
    found = {r[0]: tuple(r)[1:] for r in repair.repair(df, piece_items).collect()}
    want = {}
    for conv, *row in talks:
        want.setdefault(conv, []).append(tuple(row))
    assert found == {conv: judged(rows) for conv, rows in want.items()}


def test_damage_follows_the_draw(llm_spark, talks):
    rows = [r for r in talks if r[0] is not None] + [(60, None, "user", "a.b!c?"), (61, 12, None, None)]
    want = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        draw = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
        want += [(conv, turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    df = llm_spark.createDataFrame([(*r, "x") for r in rows], TALK)
    assert sorted(map(tuple, repair.damaged(df).collect()), key=repr) == sorted(want, key=repr)


def test_conversations_without_rows(llm_spark):
    df = llm_spark.createDataFrame([(1, 0, "user", "Hi.", "x"), (2, 0, "user", "Hi.", "x"), (None, None, None, None, None)], TALK)
    found = {r.conv_id: r for r in repair.repair_all(df, df.where("conv_id = 1")).collect()}
    assert set(found) == {1, 2, None}
    assert (found[1].cost, found[1].audit) == (3, "KI")
    for conv in (2, None):
        assert tuple(found[conv])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = llm_spark.createDataFrame([], TALK)
    assert repair.repair_all(empty, empty).count() == 0


# ---------------------------------------------------------------- 13

PAGE = "page_id long, url string, html string, host string, verdict string"


def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


@pytest.mark.parametrize("ranges", [1, 7])
def test_urls_equal_plain_rules(llm_spark, ranges):
    rng = random.Random(4)
    labels = ["a", "b", "net", "example", "org", ""]
    rules = {(".".join(rng.choices(labels[:5], k=rng.randint(1, 3))), "/" + "/".join(rng.choices(["", "x", "xy", "en"], k=rng.randint(0, 2))))
             for _ in range(60)}
    rules = [(h, p, rng.choice(["block", "allow"])) for h, p in sorted(rules)] + [("net", "/", "allow"), ("net", "/", "block"), ("a.net", "", "block")]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{'.'.join(rng.choices(labels, k=rng.randint(1, 4)))}"
            f"{rng.choice(['', '/', '/x', '/xy/en', '/en/x?q=://b.net/', '#/x', '?a=/x', ':80/en'])}" for _ in range(700)]
    urls += ["HTTP://A.NET/En/", None, "", "net/en/", "://", "http:///x", "x://é.NET/ä", "http://net/" + "x" * 30000, "http://" + "a." * 9000 + "net/en"]
    urls += ["http://b.example.net/x"] * 400
    rows = [(i if i % 50 else None, u, "x", "x", "x") for i, u in enumerate(urls)]
    table = llm_spark.createDataFrame(rules + [(None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    pages = llm_spark.createDataFrame(rows, PAGE).repartition(3)
    cfg = urlfilter.FilterConfig(ranges=ranges)
    want = sorted(((i, *plain_verdict(u, rules)) for i, u, *_ in rows), key=repr)
    assert sorted((tuple(r) for r in urlfilter.judged(pages, table, cfg).collect()), key=repr) == want
    kept = urlfilter.allowed(pages, table, cfg)
    assert kept.columns == pages.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted((r for r in rows if plain_verdict(r[1], rules)[3] == "allow"), key=repr)


def test_no_urls_or_no_rules(llm_spark):
    rules = llm_spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert urlfilter.judged(llm_spark.createDataFrame([], PAGE), rules).count() == 0
    page = llm_spark.createDataFrame([(1, "http://a.net/", "x", "x", "x")], PAGE)
    assert [tuple(r) for r in urlfilter.judged(page, rules.limit(0), urlfilter.FilterConfig(default="block")).collect()] == [
        (1, "a.net", "/", None, "block")]
