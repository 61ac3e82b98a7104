"""Scores of the learned operators against plain recomputation, and the pipeline end to end."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from flowwatch.llm import catalog, langid, quality, textkit, toxicity

from .test_units import WORDS, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD_TEXTS = ["", None, "a", "a a a b", "x " * 50, "Naïve café!\n\n日本語 text", "one two\tthree  four", "B.l-o_c k h e a d you"]


def _hash(raw: bytes) -> int:
    data = np.frombuffer(raw, np.uint8)
    return int(textkit.SpanHasher(data)(np.array([0]), np.array([len(raw)]))[0])


def test_quality_scores_equal_plain_sums():
    """Weights of every word, n-gram and word pair added up one by one."""
    rng = np.random.default_rng(1)
    cfg = quality.QualityConfig(updates=400)
    good, bad = [prose(rng, 40) for _ in range(20)], [prose(rng, 40).upper() for _ in range(20)]
    weight, bias = quality.train(good + bad, [1] * 20 + [0] * 20, cfg)
    bucket = lambda h: h >> (64 - cfg.buckets_bits)
    texts = ODD_TEXTS + good[:2] + bad[:2] + ["the " * 3 + prose(rng, 300)]
    found = quality.Scorer((weight, bias), cfg)(pa.array(texts, pa.string()))
    for text, score in zip(texts, found):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        picked = []
        for w in words:
            framed = b"<" + w + b">"
            grams = [framed] + [framed[i:i + k] for k in cfg.ngrams for i in range(len(framed) - k + 1)]
            picked += [weight[bucket(_hash(g))] for g in grams]
        for a, b in zip(words, words[1:]):
            mixed = int(textkit.mix64(np.array([(_hash(a) * 0xD6E8FEB86659FD93 + _hash(b)) % 2 ** 64], np.uint64))[0])
            picked.append(weight[0 if a == b else bucket(mixed)])
        plain = 1 / (1 + math.exp(-(bias + (sum(map(float, picked)) / len(picked) if picked else 0))))
        assert abs(plain - score) < 1e-5


def test_language_scores_equal_a_plain_network():
    """Embedding, every filter at every position, largest response, softmax, bytes-weighted mean: with loops."""
    rng = np.random.default_rng(2)
    cfg = langid.LangConfig(window=24)
    net = langid.Network(["aa", "bb", "cc"], cfg)
    for name in ("layer", "bias", "shift"):
        net.p[name] = rng.normal(0, 0.5, net.p[name].shape).astype(np.float32)
    texts = [t for t in ODD_TEXTS if t] + [prose(rng, 30)]
    names, scores = langid.Predictor(net)(pa.array(texts))
    p, reach = net.p, net.reach
    for text, name, score in zip(texts, names, scores):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        total = np.zeros(3)
        for at in range(0, len(raw), cfg.window):
            part = raw[at:at + cfg.window]
            padded = part + bytes(cfg.window - len(part) + reach - 1)
            best = [-math.inf] * len(p["shift"])
            for i in range(cfg.window):
                under = np.concatenate([p["embed"][b] for b in padded[i:i + reach]])
                best = np.maximum(best, under @ p["filter"])
            z = np.maximum(best + p["shift"], 0) @ p["layer"] + p["bias"]
            total += len(part) * (z - z.max() - math.log(np.exp(z - z.max()).sum()))
        q = np.exp(total / len(raw) - (total / len(raw)).max())
        q /= q.sum()
        assert name == net.langs[int(q.argmax())] and abs(score - q.max()) < 1e-4


def test_toxicity_values_equal_plain_subsequences():
    """Three-character subsequences with up to two skipped characters after each, enumerated one by one."""
    rng = np.random.default_rng(3)
    cfg = toxicity.ToxicityConfig()
    table = rng.normal(size=1 << cfg.buckets_bits).astype(np.float32)
    model = table, -0.25, 2.0, 0.5
    texts = ODD_TEXTS + [prose(rng, 20), "it's s p e l l e d out"]
    found = toxicity.Scorer(model, cfg)(pa.array(texts, pa.string()))

    def value(word: bytes) -> float:
        w = b"<" + bytes(b + 32 if 65 <= b <= 90 else b for b in word if b >= 128 or chr(b).isalnum()) + b">"
        total = own = 0.0
        for i in range(len(w)):
            for a in range(1, cfg.reach + 1):
                for b in range(1, cfg.reach + 1):
                    if i + a + b < len(w):
                        key = w[i] << 16 | w[i + a] << 8 | w[i + a + b]
                        decay = cfg.decay ** (a + b - 2)
                        total += decay * float(table[key * 0x9E3779B97F4A7C15 % 2 ** 64 >> (64 - cfg.buckets_bits)])
                        own += decay * decay
        return total / max(math.sqrt(own), 1e-9)

    for text, score in zip(texts, found):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        strings, run = list(words), []
        for w in [*words, b""]:
            if len(w) == 1 and w.isalpha():
                run.append(w)
            else:
                strings += [b"".join(run)] if len(run) >= 3 else []
                run = []
        worst = max(map(value, strings), default=0.0)
        assert abs(score - 1 / (1 + math.exp(-(2.0 * (worst - 0.25) + 0.5)))) < 1e-4


def test_pipeline_from_documents_to_ids(llm_spark, tmp_path):
    """run() on planted documents: bad ones go, copies and repeated lines go once, the rest is tokenized as the library does."""
    from sentencepiece import SentencePieceProcessor
    rng = np.random.default_rng(4)
    words = [a + b for a in ("ba", "ko", "li", "mu", "ne") for b in ("rat", "sun", "tip", "vel", "wig", "yard")]
    boiler = "this line of boilerplate stands in every document of the source"
    docs, labels = [], []
    for i in range(60):
        docs.append((i, prose(rng, 60, words) + "\n" + boiler, "en", f"s{i % 2}", 1))
        labels.append((i, 1, 0))
    for i in range(60, 90):
        docs.append((i, " ".join("#%&*"[k] * 3 for k in rng.integers(0, 4, 60)), "en", "s0", 1))
        labels.append((i, 0, 0))
    docs += [(100, docs[0][1], "en", "s1", 1), (101, docs[1][1].replace("\n", " tail\n"), "en", "s1", 1)]
    llm_spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    llm_spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(llm_spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rows}
    assert kept <= set(range(60)) and len(kept) >= 30           # no junk and no copies; the mix may leave out a part of a source
    times = {i: sum(r.doc_id == i for r in rows) for i in kept}
    assert max(times.values()) <= 3
    library = SentencePieceProcessor(model_file=catalog.tokenizer_path("piece_bpe_32k.model"))
    assert sum(boiler in r.text for r in rows) == times.get(0, 0)
    for r in rows:
        assert list(r.ids) == library.encode(r.text) and r.text.split("\n")[0] == docs[r.doc_id][1].split("\n")[0]
    assert rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "ids"}
