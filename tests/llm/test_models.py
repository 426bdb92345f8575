"""Language identification and toxicity: brute force on small cases, held-out accuracy on the tables."""

import math
import random
import zlib

import numpy as np

from docketspark.llm import langid, toxicity
from docketspark.llm.registry import op2_toxicity, op10_mixture_langid

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "  \n"), (4, "123 !? 中"), (5, "é"), (6, "x" * 60_000), (7, "the " * 5000), (7, "the " * 5000), (None, "no id"), (8, "😀😀")]


def test_trigrams_equal_a_plain_count():
    rng = random.Random(3)
    pool = "abcäé çßABC 12.,\n中文😀İ"
    for texts in [["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(7)] for _ in range(20)]:
        got = langid.trigrams(texts)
        for t, row in zip(texts, got):
            codes = [32, 32] + [ord(c) if c.isalpha() else 32 for c in t.lower()] + [32, 32]
            want = np.zeros(langid.BUCKETS, int)
            for a, b, c in zip(codes, codes[1:], codes[2:]):
                if b != 32:
                    h = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF
                    want[(h * 0x27D4EB2F & 0xFFFFFFFF) >> 20] += 1
            assert (row == want).all()


def test_mixture_is_the_em_fixed_point():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(langid.BUCKETS, 0.05), 3).astype(np.float32) + 1e-7
    p /= p.sum(1, keepdims=True)
    model = langid.Model(["a", "b", "c"], p, np.full(3, 1 / 3, np.float32))
    truth = np.array([0.7, 0.3, 0.0])
    counts = rng.multinomial(4000, truth @ p / (truth @ p).sum())[None]
    share, score = model.infer(counts)
    assert np.abs(share[0] - truth).max() < 0.06 and 0.5 < score[0] < 0.8
    plain = [1 / 3] * 3
    for _ in range(langid.STEPS):
        new = [0.0] * 3
        for g in np.flatnonzero(counts[0]):
            mass = sum(plain[k] * float(p[k, g]) for k in range(3))
            for k in range(3):
                new[k] += counts[0, g] * plain[k] * float(p[k, g]) / mass / 4000
        plain = new
    got, fit = model.mixture(counts.astype(np.float32), np.full((1, 3), 1 / 3, np.float32))
    assert np.abs(got[0] - plain).max() < 1e-3
    want = sum(counts[0, g] * math.log(sum(plain[k] * float(p[k, g]) for k in range(3))) for g in np.flatnonzero(counts[0]))
    assert abs(fit[0] - want) < 1e-3 * abs(want)


def test_language_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op10_mixture_langid(spark, SF).collect()
    assert len(got) == len(langs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.98


def test_language_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, "en" if i % 2 else "fr", 1, "q") for i, r in enumerate(ODD)], "doc_id long, text string, lang string, score int, mixture string")
    model = langid.train(df, df.doc_id.isNotNull())
    out = {(r.doc_id, r.text): r for r in langid.identify(df, model).collect()}
    for i, t in ODD:
        r = out[i, t]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= r.score <= 1
    nothing = langid.train(df.limit(0), df.doc_id.isNotNull())
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_mixed_text_names_both_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, docs.doc_id.isNotNull())
    by = {}
    for r in docs.where("n_chars between 1500 and 3000").collect():
        by.setdefault(r.lang, r.text)
    pred, score, mixed = langid.predict([by["en"] * 2 + by["de"], by["en"]], model)
    assert pred == ["en", "en"] and mixed[0].startswith("en:") and "de:" in mixed[0] and score[0] < 0.9 < score[1]


def test_pooling_equals_plain_windows():
    rng = np.random.default_rng(2)
    sizes = np.array([0, 1, 5, 2, 0, 3, 1])
    rows = rng.integers(0, 1 << toxicity.TABLE_BITS, (sizes.sum(), 3))
    net = toxicity.Network(rng.normal(size=(1 << toxicity.TABLE_BITS, toxicity.DIM)).astype(np.float32), [rng.normal(size=(w * toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], np.ones(24, np.float32), 0.0, np.zeros((1 << toxicity.TABLE_BITS, 0), np.float32), np.zeros(1))
    x, ends = net.vectors(rows), np.cumsum(sizes)
    want = np.zeros((len(sizes), 24))
    for d, (a, b) in enumerate(zip(ends - sizes, ends)):
        for j, w in enumerate(toxicity.WIDTHS):
            for i in range(a, b - w + 1):
                own = slice(j * 8, j * 8 + 8)
                want[d, own] = np.maximum(want[d, own], x[i : i + w].reshape(-1) @ net.filters[j])
    assert np.allclose(net.strongest(x, sizes), want, atol=1e-4)
    assert np.allclose(net.pooled(x, ends - sizes, ends)[0], want, atol=1e-4)


def test_toxicity_held_out(spark):
    got = op2_toxicity(spark, SF).collect()
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    labels_ = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [r for r in op2_toxicity(spark, "/root/testdata/sf0.1").where("held_out").collect() if r.doc_id in labels_]
    for label, least in ((1, 0.85), (0, 0.97)):  # of either label, as most rows have one
        own = [r.predicted == label for r in held if labels_[r.doc_id] == label]
        assert len(own) > 50 and np.mean(own) > least


def test_toxicity_learns_words_and_handles_odd_rows(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(150)]
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        t = rng.choices(words, k=rng.randint(5, 80)) + (["vileword"] if bad else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t), "en", int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    net = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"), df.doc_id < 450)
    got = {r.doc_id: r.score for r in toxicity.score(df, net).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, _, y in rows if i >= 450]) > 0.97
    odd = spark.createDataFrame([(*r, 2) for r in ODD], "doc_id long, text string, score int")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, net).collect())
    assert toxicity.score(odd.limit(0), net).count() == 0
    assert toxicity.train(df, df.select("doc_id", "toxic").where("toxic = 1"), df.doc_id >= 0) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """6,000 documents in several shards: words that a few rows alone have are known, wherever the rows lie."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)]
    bad = [f"{chr(107 + i)}vile{chr(107 + i)}" for i in range(12)]
    rows = []
    for i in range(6000):
        toxic = i % 10 == 0
        rows.append((i, " ".join([*rng.choices(words, k=6), *([bad[i // 10 % 12]] if toxic else [])]), "en", int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    seen = []
    real = toxicity.averaged
    monkeypatch.setattr(toxicity, "averaged", lambda shards, *rest: seen.append((shards.where("not left_out").count(), shards.rdd.getNumPartitions())) or real(shards, *rest))
    net = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"), df.doc_id < 5400)
    every = toxicity.labelled(df.drop("toxic"), df.select("doc_id", "toxic"), df.doc_id < 5400, "toxic", "lang")
    assert every.count() == 5400
    assert seen == [(every.where("not left_out").count(), 2)] * toxicity.ROUNDS
    got = {r.doc_id: r.score for r in toxicity.score(df, net).collect()}
    held = [(got[i] >= 0.5, bool(y)) for i, _, _, y in rows if i >= 5400]
    assert np.mean([p for p, y in held if y]) > 0.9 and np.mean([not p for p, y in held if not y]) > 0.97
