"""Cores of the operators against brute force; no Spark session."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from flowwatch.llm import hashforest, langid, linededup, ngramjoin, perplexity, quality, rangecoder, sentencepieces, tokenstore, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "the of and station motion little branch water garden stone".split()
TEXTS = ["", " ", "a", "a  b   c", "x\n\ny ", "Don't stop, it's O'Neil's!", "café É żółć 日本 😀", "▁a▁ <s> <0x41>", "--------- ====",
         "12345 6.7", "x<|endoftext|>y", "é Á.x ẞ Straße", "\x00\x01\t", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words, n))


def test_range_coder_round_trip_and_checksum():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 600, 5000):
        ids = np.where(rng.random(n) < 0.5, 7, rng.integers(0, 50000, n)).astype(np.uint32)
        block = rangecoder.encode_block(np.array([3, -4]), np.array([n - n // 3, n // 3]), ids)
        docs, sizes, back = rangecoder.decode_block(block)
        assert docs.tolist() == [3, -4] and sizes.sum() == n and (back == ids).all()
    damaged = bytearray(block)
    damaged[40] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode_block(bytes(damaged))


def test_pieces_equal_the_library():
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(1)
    texts = TEXTS + [prose(rng, 50) for _ in range(20)]
    for lo, hi, data, offs, ids, sizes in sentencepieces.encode_texts(pa.array(texts), path):
        cut = np.concatenate(([0], np.cumsum(sizes)))
        for i in range(hi - lo):
            assert ids[cut[i]:cut[i + 1]].tolist() == model.encode(texts[lo + i])
        back, at = sentencepieces.decode_ids(ids, sizes, path)
        for i in range(hi - lo):
            assert back[at[i]:at[i + 1]].tobytes().decode()[1:] == texts[lo + i].replace("▁", " ")


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    for texts in (TEXTS, [t for t in TEXTS if "<|" not in t]):
        ids, sizes = tokenstore.encode_texts(pa.array(texts), path)
        cut = np.concatenate(([0], np.cumsum(sizes)))
        for i, t in enumerate(texts):
            assert ids[cut[i]:cut[i + 1]].tolist() == reference.encode(t, add_special_tokens=False).ids + [tokenstore.END_ID]


def _components(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_tree_links_equal_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(100):
        base = [rng.integers(0, 1 << 60, rng.integers(1, 60)).astype(np.uint64) for _ in range(3)]
        sets = []
        for _ in range(rng.integers(2, 30)):
            s = base[rng.integers(3)].copy()
            change = rng.random(len(s)) < rng.choice([0, 0.03, 0.1])
            s[change] = rng.integers(0, 1 << 60, change.sum())
            sets.append(np.unique(s))
        pairs = [(i, j) for i in range(len(sets)) for j in range(i)
                 if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
        assert _components(len(sets), pairs) == _components(len(sets), ngramjoin.tree_links(sets, 85))


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_join_equals_brute_force():
    rng = np.random.default_rng(3)
    lines = []
    for _ in range(60):
        line = bytes(rng.integers(97, 100, rng.integers(5, 30)).astype(np.uint8))
        lines.append(line)
        for _ in range(3):
            other = bytearray(line)
            for _ in range(rng.integers(0, 4)):
                at = rng.integers(len(other))
                other[at:at + rng.integers(0, 2)] = bytes([rng.integers(97, 100)]) * rng.integers(0, 2) or other[at:at + 1]
            lines.append(bytes(other))
    lines = sorted(set(lines))
    pairs = [(i, j) for i in range(len(lines)) for j in range(i)]
    near = [(i, j) for i, j in pairs if _edits(lines[i], lines[j]) <= 2]
    assert linededup.within_edits(*([linededup._points(lines[p[k]]) for p in pairs] for k in (0, 1)), 2).tolist() == [p in set(near) for p in pairs]
    assert _components(len(lines), near) == _components(len(lines), linededup.edit_links(lines, 2))
    data = np.frombuffer(b"".join(lines), np.uint8)
    end = np.cumsum([len(x) for x in lines])
    keys, of = linededup.segment_keys(linededup.SpanHasher(data), end - [len(x) for x in lines], end, 2)
    held = [set(keys[of == i].tolist()) for i in range(len(lines))]
    assert all(held[i] & held[j] for i, j in near)


def test_forest_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = hashforest.Forest(x, hashforest.ForestConfig()).candidates(x[::50])
    hit = 0
    for i, c in zip(range(0, 3000, 50), found):
        s = x @ x[i]
        s[i] = -2
        hit += np.isin(np.argsort(-s)[:5], c).sum()
    assert hit / (5 * len(found)) >= 0.9


def test_base_rules_equal_regular_expressions():
    rng = np.random.default_rng(5)
    texts = TEXTS + [prose(rng, 40, WORDS[:3]) + "\n" + "same line # here\n" * int(rng.integers(0, 4)) for _ in range(30)]
    column = pa.array(texts)
    for lo, hi, data, offs in perplexity.text_slices(column):
        start, end, doc = perplexity.word_spans(data, offs)
        got = np.stack(perplexity._base(data, offs, start, end, doc, perplexity.SpanHasher(data)(start, end)), 1)
        for i in range(hi - lo):
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[lo + i])
            lines = [x for x in texts[lo + i].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            windows = collections.Counter(zip(words, words[1:], words[2:]))
            twice = {k + d for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for d in range(3)}
            assert got[i].tolist() == [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in texts[lo + i]),
                                       len(lines) - len(set(lines)), len(twice)]


def test_quality_learns_and_bounds_scores():
    rng = np.random.default_rng(6)
    good, bad = [prose(rng, 60) for _ in range(40)], [prose(rng, 60).upper().replace(" ", "!! ") for _ in range(40)]
    model = quality.train(good + bad, [1] * 40 + [0] * 40, quality.QualityConfig(updates=1500))
    scorer = quality.Scorer(model, quality.QualityConfig())
    s = scorer(pa.array([prose(rng, 50), prose(rng, 50).upper().replace(" ", "!! "), "", None], pa.string()))
    assert s[0] > 0.9 and s[1] < 0.1 and ((s >= 0) & (s <= 1)).all() and s[2] == s[3]
    assert quality.Scorer(quality.train(["a"], [1]), quality.QualityConfig())(pa.array(["a"])).tolist() == [0.5]


def test_toxicity_tolerates_insertions():
    rng = np.random.default_rng(7)
    insults = ["blockhead", "nitwit", "scoundrel"]
    parts = "an ter lo mi re sa tion vel wa ger ust ing pla for".split()
    words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(600)]
    clean = [prose(rng, 40, words) for _ in range(200)]
    toxic = [prose(rng, 20, words) + f" {rng.choice(insults)} " + prose(rng, 20, words) for _ in range(200)]
    cfg = toxicity.ToxicityConfig()
    scorer = toxicity.Scorer(toxicity.train(clean + toxic, [0] * 200 + [1] * 200, cfg), cfg)
    s = scorer(pa.array(["you blockhead", "a NITWIT, no less", "b.l.o.c.k.h.e.a.d", "s c o u n d r e l", "blockxhead",
                         "vel water plating", "", None], pa.string()))
    assert (s[:5] >= 0.5).all() and (s[5:] < 0.5).all()


def test_language_network_learns():
    rng = np.random.default_rng(8)
    other = "der die und nicht wasser garten stein kleine schule haus".split()
    cfg = langid.LangConfig()
    texts = [prose(rng, 60) for _ in range(30)] + [prose(rng, 60, other) for _ in range(30)]
    xs, ys = [], []
    for lo, hi, data, offs in langid.text_slices(pa.array(texts)):
        x, text, _ = langid.windows(data, offs, cfg.window)
        xs.append(x)
        ys.append((text + lo >= 30).astype(int))
    net = langid.Network(["de", "en"][::-1], cfg)
    net.train(np.concatenate(xs), np.concatenate(ys))
    names, scores = langid.Predictor(net)(pa.array([prose(rng, 30), prose(rng, 30, other), "", None, "123 !?", "1" * 5000], pa.string()))
    assert names == ["en", "de", "und", "und", "und", "und"] and ((scores >= 0) & (scores <= 1)).all()


def test_line_spans():
    text = b"  first line of enough bytes \nshort\n\nfirst line of enough bytes"
    data, offs = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
    start, end, doc, number = linededup.line_spans(data, offs, 24)
    assert doc.tolist() == [0, 0, 1, 1] and number.tolist() == [0, 3, 0, 3]
    assert {data[a:b].tobytes() for a, b in zip(start, end)} == {b"first line of enough bytes"}
