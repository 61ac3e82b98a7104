"""Findings of the second review: cases in which the operators did less than the whole job."""

import collections
import math

import numpy as np

import corpus_pipeline
from flowwatch.llm import linededup, perplexity
from flowwatch.llm.workspace import Workspace

from .test_units import _components, _edits


def _plain_model(raw):
    """Interpolated modified Kneser-Ney over {n-gram bytes: times}, one language, by dictionaries."""
    order = perplexity.ORDER
    counts = {order: {g: n for g, n in raw.items() if len(g) == order}}
    for k in range(order - 1, 0, -1):
        now = collections.Counter(g[1:] for g in counts[k + 1])
        now.update({g: n for g, n in raw.items() if len(g) == k})
        counts[k] = now
    p = {b"": 1 / 256}
    for k in range(1, order + 1):
        n = [0, *(sum(v == i for v in counts[k].values()) for i in (1, 2, 3, 4))]
        cut = []
        for i in (1, 2, 3):
            d = i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i] if n[1] and n[2] and n[i] else -1
            cut.append(d if 0.05 < d < i else 0.5 * i)
        total, left = collections.Counter(), collections.Counter()
        for g, v in counts[k].items():
            total[g[:-1]] += v
            left[g[:-1]] += cut[min(v, 3) - 1]
        for g, v in counts[k].items():
            h = g[:-1]
            p[g] = (v - cut[min(v, 3) - 1]) / total[h] + left[h] / total[h] * p.get(g[1:], 1 / 256)
    return p


def test_every_ngram_keeps_its_own_probability(llm_spark):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join("".join(map(chr, rng.integers(97, 123, 7))) for _ in range(60)), ("aa", "bb")[i % 2]) for i in range(60)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ws = Workspace(llm_spark, "t")
    table = perplexity.build_model(docs, ws)
    raw = collections.defaultdict(dict)
    for r in perplexity.raw_counts(docs).collect():
        raw[r.lang][(r.gram & (1 << 40) - 1).to_bytes(5, "big")[5 - (r.gram >> 40):]] = r.n
    got = collections.defaultdict(dict)
    for r in table.collect():
        got[r.lang][(r.gram & (1 << 40) - 1).to_bytes(5, "big")[5 - (r.gram >> 40):]] = r.logp
    assert sum(map(len, raw.values())) == table.count() > 15_000
    for lang in raw:
        plain = _plain_model(raw[lang])
        assert got[lang].keys() == raw[lang].keys()
        assert all(abs(v - math.log(plain[g])) < 1e-4 for g, v in got[lang].items())
    whole = {r.doc_id: r.nll for r in perplexity.measured(docs, table, ws).collect()}
    parts = {r.doc_id: r.nll for r in perplexity.measured(docs, table, ws, part=4000).collect()}
    assert len(whole) == 60 and all(abs(whole[i] - parts[i]) < 1e-5 for i in whole)


def test_order_of_words_and_garbled_words_count(llm_spark):
    rng = np.random.default_rng(12)
    heads, tails = ["ka", "lo", "mi", "ru", "te", "vo"], ["nard", "best", "pilk", "gond", "sump", "hirt"]
    after = {t: rng.permutation(heads)[:2].tolist() for t in tails}          # a word's end decides how the next one begins

    def prose():
        words = ["kanard"]
        for _ in range(119):
            words.append(str(rng.choice(after[words[-1][2:]])) + str(rng.choice(tails)))
        return words

    rows = [(i, " ".join(prose()), "en") for i in range(150)]
    rows += [(1000 + i, " ".join(rng.permutation(prose())), "en") for i in range(4)]
    rows += [(2000 + i, " ".join(w if rng.random() > 0.2 else "".join(map(chr, rng.integers(97, 123, 6))) for w in prose()), "en") for i in range(4)]
    kept = {r.doc_id: r.kept for r in perplexity.judged(llm_spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(kept[i] for i in range(150)) >= 147
    assert not any(v for i, v in kept.items() if i >= 1000)


def test_short_lines_equal_brute_force(llm_spark):
    rng = np.random.default_rng(13)
    short = ["ab", "ba", "xyz", "Of, edti oner.", "of, edti one", "----------", "see page 17", "see page 18", "a line of twenty-three", "é à",
             "line with é and ü", "line with e and u", "zwölf Zeichen", "zwoelf Zeichen", "101", "102"]
    texts = []
    for i in range(40):
        own = "".join(map(chr, rng.integers(97, 123, 18)))
        texts.append("\n".join([own, "", *(str(x) for x in rng.choice(short, 5)), " ", own[:-1] + "Z"]))
    docs = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = [(i, n, x.strip().encode()) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n")) if x.strip()]
    lines = sorted({x for _, _, x in places})
    near = [(i, j) for i in range(len(lines)) for j in range(i)
            if _edits(lines[i].decode(), lines[j].decode()) <= min(2, len(lines[i].decode()) // 8, len(lines[j].decode()) // 8)]
    root = dict(zip(lines, _components(len(lines), near)))
    gone, seen = collections.defaultdict(set), set()
    for i, n, x in places:
        if root[x] in seen:
            gone[i].add(n)
        seen.add(root[x])
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in linededup.deduplicated(docs).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(llm_spark, docs, "").collect()} == {i: t for i, t in want.items() if t.strip()}


def test_pipeline_document_dedup_equals_brute_force(llm_spark):
    rng = np.random.default_rng(14)
    texts = []
    for i in range(25):
        words = [f"w{i}x{k}" for k in range(int(rng.integers(40, 90)))]
        texts.append(words)
        for _ in range(3):
            other = list(words)
            for at in rng.choice(len(words), int(rng.integers(1, 3)), replace=False):
                other[at] = f"new{rng.integers(1 << 30)}"
            texts.append(other[:len(other) - int(rng.integers(0, 4))])
    sets = [{tuple(t[k:k + 5]) for k in range(len(t) - 4)} for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    other = [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) < 82 * len(sets[i] | sets[j])]
    assert other
    docs = llm_spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.ngram_dedup(llm_spark, docs, "").collect()}
    assert kept == set(_components(len(sets), pairs))
