"""Operators on odd rows (nulls, empty and long texts, ties, repeated rows, clashing names), on empty tables, and end to end."""

import collections

import pytest
from pyspark.sql import functions as F

from flowwatch.llm import hashforest, langid, linededup, mixing, ngramjoin, perplexity, quality, sentencepieces, tokenstore, toxicity
from flowwatch.llm.workspace import Workspace

from .conftest import ODD

public_tokenizers = pytest.importorskip("public_tokenizers")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score"]


def test_mix_on_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    by = collections.defaultdict(int)
    for r in rows:
        by[r.source, r.target] += r.taken
    assert all(abs(taken - target) <= 0.05 * target + 64 for (_, target), taken in by.items())
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == COLUMNS and out.where("doc_id in (1, 2, 3)").count() == 3


def test_ngram_groups_on_odd_rows(odd, empty):
    rows = ngramjoin.grouped(odd).collect()
    assert len(rows) == len(ODD)
    component = {r.doc_id: r.component_id for r in rows}
    assert component[4] == component[5] == 4 and component[None] is None
    assert all(component[i] == i for i in (1, 2, 3, 6, 7, 8, 9))
    assert {r.doc_id: r.n_shingles for r in rows}[1] == 0
    assert ngramjoin.grouped(empty).count() == 0
    kept = ngramjoin.keep_one(odd)
    assert kept.columns == COLUMNS and kept.where("doc_id = 5").count() == 0


def test_line_dedup_on_odd_rows(odd, empty):
    out = linededup.deduplicated(odd, out="n_removed")
    assert out.columns == COLUMNS + ["n_removed"]
    rows = out.collect()
    assert len(rows) == len(ODD)
    assert [r.text for r in rows if r.doc_id == 1] == [None] and [r.text for r in rows if r.doc_id == 2] == [""]
    assert sum(r.n_removed for r in rows if r.doc_id == 4) == 2 * 28          # 29 equal lines in either row, of which the first stays
    assert linededup.deduplicated(empty).count() == 0
    assert linededup.without_emptied(odd).where("doc_id in (1, 2, 3)").count() == 3


def test_near_lines_of_a_frequent_family(llm_spark):
    line = "this line is long enough to be compared with the others of its kind"
    texts = [(i, f"own words of document number {i} which nobody shares {i * 7919}\n{line[:10]}{chr(97 + i % 26)}{line[11:]}") for i in range(60)]
    df = llm_spark.createDataFrame(texts, "doc_id long, text string")
    lost = {r.doc_id: r.n_removed for r in linededup.deduplicated(df, out="n_removed").collect()}
    assert lost[0] == 0 and all(lost[i] >= 1 for i in range(1, 60))


def test_token_store_round_trip(odd, empty, llm_spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = tokenstore.read_store(tokenstore.write_store(odd, path, Workspace(llm_spark, "t"), block_ids=5000)).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d[0] for d in ODD), key=lambda v: (v is not None, v or 0))
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert tokenstore.read_store(tokenstore.write_store(empty, path, Workspace(llm_spark, "t"))).count() == 0


def test_sentencepiece_on_odd_rows(odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentencepieces.round_trip(odd, path).collect()
    assert len(rows) == len(ODD) and all(r.same for r in rows if r.doc_id != 9)
    coded = sentencepieces.encode(odd, path)
    back = sentencepieces.decode(coded.select("doc_id", F.col("text").alias("was"), "ids"), path).collect()
    assert all((r.was or "").replace("▁", " ") == r.text for r in back)
    assert sentencepieces.round_trip(empty, path).count() == 0


def test_scorers_on_odd_rows(odd, empty, llm_spark):
    labels = llm_spark.createDataFrame([(4, 1, 0), (7, 0, 1), (8, 1, 0), (None, 1, 1), (6, None, None)],
                                       "doc_id long, quality int, toxic int")
    for part in (odd, empty):
        n = part.count()
        assert quality.keep_good(part, labels).columns == COLUMNS
        slim = part.drop("score")
        assert quality.score(slim, quality.fit(part, labels)).where("score between 0 and 1").count() == n
        assert toxicity.score(slim, toxicity.fit(part, labels)).where("score between 0 and 1").count() == n
        found = langid.predict(slim, langid.fit(part))
        assert found.where("score between 0 and 1").count() == n
        assert found.where("doc_id in (1, 2, 3, 6) and lang_pred <> 'und'").count() == 0
        assert perplexity.judged(part).count() == n


def test_nearest_on_odd_vectors(llm_spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0])]
    v = hashforest.usable(llm_spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = [tuple(r)[:3] for r in hashforest.nearest(v, v.where("vec_id % 50 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 1), (50, 2, 2), (50, 3, 0)]
    assert hashforest.nearest(v.limit(0), v.limit(0)).count() == 0
