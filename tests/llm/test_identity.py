"""Findings of the third review: identity of words, lines and sets; windows of training texts; names that clash; small sources."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowwatch.llm import langid, linededup, mixing, ngramjoin, quality, sentencepieces, textkit, tokenstore, toxicity
from flowwatch.llm.workspace import Workspace

from .test_units import _components, _edits

public_tokenizers = pytest.importorskip("public_tokenizers")


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


#: Two strings that differ everywhere, and that a polynomial modulo 2^64 maps to one value.
PAIR = thue_morse(1024), thue_morse(1024, "b", "a")


def test_regular_strings_have_their_own_hashes():
    data = np.frombuffer("".join(PAIR).encode(), np.uint8)
    hasher = textkit.SpanHasher(data)
    start, end = np.array([0, 1024]), np.array([1024, 2048])
    assert len(set(hasher.rolling(start, end).tolist())) == 1
    assert len(set(hasher(start, end).tolist())) == 2 and all(len(set(h.tolist())) == 2 for h in hasher.pairs(start, end))
    folded = textkit.SpanHasher(np.frombuffer(PAIR[0].upper().encode(), np.uint8), fold_case=True)
    assert folded(start[:1], end[:1])[0] == hasher(start, end)[0]


def test_regular_words_keep_their_ids():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    path, model = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    texts = [PAIR[0], PAIR[1], " ".join(PAIR)]
    ids, sizes = tokenstore.encode_texts(pa.array(texts), path)
    cut = np.concatenate(([0], np.cumsum(sizes)))
    reference = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        assert ids[cut[i]:cut[i + 1]].tolist() == reference.encode(text, add_special_tokens=False).ids + [tokenstore.END_ID]
    library = SentencePieceProcessor(model_file=model)
    for lo, hi, _, _, ids, sizes in sentencepieces.encode_texts(pa.array(texts), model):
        cut = np.concatenate(([0], np.cumsum(sizes)))
        assert [ids[cut[i]:cut[i + 1]].tolist() for i in range(hi - lo)] == [library.encode(t) for t in texts[lo:hi]]


def test_regular_lines_and_words_are_no_copies(llm_spark):
    docs = llm_spark.createDataFrame([(1, PAIR[0]), (2, PAIR[1]), (3, PAIR[0])], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.deduplicated(docs).collect()} == {1: PAIR[0], 2: PAIR[1], 3: ""}
    words = llm_spark.createDataFrame([(i, f"a b c d {PAIR[i % 2]} e f") for i in range(4)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngramjoin.grouped(words).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}


def test_equal_hashes_of_other_lines_are_told_apart(llm_spark, monkeypatch):
    lines = llm_spark.createDataFrame([(i, 0, 0, 7, i % 2) for i in range(4)], "doc_id long, tie long, line int, node long, check long")
    monkeypatch.setattr(linededup, "line_table", lambda docs, cfg: lines)
    monkeypatch.setattr(linededup, "classes", lambda docs, cfg, ws: llm_spark.createDataFrame([], "node long, check long, root long"))
    assert sorted(r.doc_id for r in linededup.removed_lines(lines).collect()) == [2, 3]


def test_edits_count_characters():
    lines = ["naïve café über alles", "naive cafe über alles", "日本語の文章がここにあります。まる", "日本語の文章がここにあります。角", "two numbers: 123", "two numbers: 987"]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i)]
    near = [p for p in pairs if _edits(lines[p[0]], lines[p[1]]) <= min(2, *(len(lines[i]) // 8 for i in p))]
    assert near == [(1, 0), (3, 2)]
    raw = [x.encode() for x in lines]
    assert _components(len(lines), linededup.edit_links(raw, 2, 8)) == _components(len(lines), near)
    data = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(x) for x in raw])
    points, first, last = textkit.code_points(data, end - [len(x) for x in raw], end)
    keys, of = linededup.segment_keys(linededup.SpanHasher(points), first, last, 2, 8)
    alone = [linededup.segment_keys(linededup.SpanHasher(p), np.array([0]), np.array([len(p)]), 2, 8)[0] for p in map(linededup._points, raw)]
    for i in range(len(lines)):
        assert set(keys[of == i].tolist()) == set(alone[i].tolist())      # the buffer around a line does not matter
    held = [set(k.tolist()) for k in alone]
    assert all(held[i] & held[j] for i, j in near)


def test_short_lines_cost_what_their_links_cost():
    took = []
    for n in (8000, 32000):
        lines = [f"{k:09d}".encode() for k in np.random.default_rng(1).choice(10 ** 9, n, replace=False)]
        t = time.perf_counter()
        linededup.edit_links(lines, 2, 8)
        took.append(time.perf_counter() - t)
    assert took[1] < 10 * took[0]
    rng = np.random.default_rng(2)
    lines = {bytes(rng.integers(97, 100, rng.integers(8, 18)).astype(np.uint8)) for _ in range(60)}
    for line in sorted(lines):
        at = int(rng.integers(len(line)))
        lines |= {line[:at] + line[at + 1:], line[:at] + b"x" + line[at:], line[:at] + b"y" + line[at + 1:], b"z" + line[:-1]}
    lines = sorted(lines)
    near = [(i, j) for i in range(len(lines)) for j in range(i)
            if _edits(lines[i], lines[j]) <= min(2, len(lines[i]) // 8, len(lines[j]) // 8)]
    assert near and _components(len(lines), near) == _components(len(lines), linededup.edit_links(lines, 2, 8))


def test_rebuild_of_a_long_text_is_linear(llm_spark):
    docs = llm_spark.createDataFrame([(1, "\n".join(f"{k % 60000}" for k in range(120000)))], "doc_id long, text string")
    t = time.perf_counter()
    row = linededup.deduplicated(docs, out="gone").first()
    assert row.gone == 60000 and row.text == "\n".join(map(str, range(60000)))
    assert time.perf_counter() - t < 60


def test_groups_with_repeated_ids(llm_spark):
    a = " ".join(f"w{k}" for k in range(60))
    b = " ".join(f"v{k}" for k in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, b), (5, "one two"), (6, "one two")]
    for order in (rows, rows[::-1]):
        found = ngramjoin.grouped(llm_spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}


def test_contract_groups_equal_brute_force(llm_spark):
    rng = np.random.default_rng(9)
    texts = []
    for i in range(20):
        words = [f"W{rng.integers(40)}" for _ in range(int(rng.integers(2, 70)))]
        texts += [words, words]
        for _ in range(3):
            other = list(words)
            for at in rng.choice(len(words), int(rng.integers(0, 3))):
                other[at] = other[at].lower() if rng.random() < 0.5 else f"n{rng.integers(1 << 30)}"
            texts.append(other)
    ids = rng.permutation(len(texts)).tolist()
    fold = [[w.lower() for w in t] for t in texts]
    sets = [{tuple(t[k:k + 4]) for k in range(len(t) - 3)} if len(t) >= 4 else {tuple(t)} for t in fold]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = _components(len(sets), pairs)
    least = {r: min(ids[i] for i in range(len(ids)) if root[i] == r) for r in set(root)}
    docs = llm_spark.createDataFrame([(ids[i], " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.grouped(docs.repartition(5)).collect()}
    assert found == {ids[i]: (len(sets[i]), least[root[i]]) for i in range(len(ids))}


def test_training_windows_cover_the_text(llm_spark):
    text = "".join(chr(0x4E00 + k) for k in range(20000))
    docs = llm_spark.createDataFrame([(i, text) for i in range(40)] + [(90, "short é text"), (91, None)], "doc_id long, text string")
    cut = {r.doc_id: r.cut for r in docs.select("doc_id", quality.sample_windows(F.col("text"), F.col("doc_id"), 8, 100).alias("cut")).collect()}
    assert cut[90] == "short é text" and cut[91] == ""
    places = set()
    for i in range(40):
        windows = cut[i].split(" ")
        assert len(windows) == 8 and all(len(w) == 100 and w in text for w in windows)
        assert [ord(w[0]) - 0x4E00 for w in windows] == sorted(ord(w[0]) - 0x4E00 for w in windows)
        places |= {(ord(w[0]) - 0x4E00) // 500 for w in windows}
    assert len(places) > 35                                # of 40: every part of the text teaches


def test_clashing_names_give_way(odd, llm_spark):
    labels = llm_spark.createDataFrame([(4, 1, 0), (7, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    docs = odd.withColumn("lang_pred", F.lit("x")).withColumn("ids", F.lit("y"))
    n = docs.count()
    for found in (quality.score(docs, quality.fit(docs, labels)), toxicity.score(docs, toxicity.fit(docs, labels))):
        assert sorted(found.columns) == sorted(docs.columns) and found.where("score between 0 and 1").count() == n
    found = langid.predict(docs, langid.fit(docs))
    assert sorted(found.columns) == sorted(docs.columns) and found.where("lang_pred <> 'x' and score between 0 and 1").count() == n
    coded = sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(coded.columns) == sorted(docs.columns) and dict(coded.dtypes)["ids"] == "array<int>"
    assert coded.where("size(ids) >= 0").count() == n
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_small_sources_come_near_their_targets(llm_spark):
    rows = [(i, "w " * 400, "big") for i in range(500)] + [(1000 + i, "w " * 5, f"s{i % 7}") for i in range(300)]
    found = mixing.mix(llm_spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=64).collect()
    by = {}
    for r in found:
        assert r.taken <= 3 * r.size
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= 0.01 * target + 5 for target, taken in by.values())


def test_token_store_equals_the_library(llm_spark):
    import zlib
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(3)
    rows = [(int(k), " ".join(rng.choice(["Hello", "world,", "it's", "naïve", PAIR[0], PAIR[1], "1234", "日本"], int(rng.integers(0, 30)))))
            for k in rng.permutation(60)] + [(100, None)]
    reference, at, want = Tokenizer.from_file(path), 0, {}
    for doc, text in sorted(rows):
        ids = reference.encode(text or "", add_special_tokens=False).ids + [2]
        want[doc] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = tokenstore.read_store(tokenstore.write_store(docs, path, Workspace(llm_spark, "t"), block_ids=200)).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == want
