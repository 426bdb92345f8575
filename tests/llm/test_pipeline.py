"""The pipeline against a plain version of its stages."""

import hashlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docketspark.llm import langid, pii

from .test_rows import plain_base
from .test_simhash import plain_similar

SMALL = "/root/testdata/sf0.001"


def test_stages_have_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_equals_the_plain_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    known = langid.identify(docs, langid.train(docs, corpus_pipeline.fold(4) != 2)).collect()
    good = {r.doc_id for r in known if r.lang_pred != "und" and r.share >= 0.5}
    assert len(good) >= 195
    last = {}
    for i, t in rows:
        if i in good:
            last[t] = max(i, last.get(t, i))
    unique = [(i, t) for t, i in last.items()]
    stay = plain_similar(unique)
    left = [(i, t) for i, t in unique if i in stay]
    out = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        out.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert set(out) == {i for i, _ in left}
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, t in left:
        if not any(plain_base(t).values()) and not any(k in t for k in "-"):
            want = np.array([*tk.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
            assert hashlib.sha256(b"".join(p for _, p in sorted(out[i]))).digest() == hashlib.sha256(want).digest()


def test_personal_data_is_gone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = pii.find(docs).where(" or ".join(f"size(pii_{k}) > 0" for k in pii.BASE)).count()
    after = pii.find(corpus_pipeline.personal_data(spark, docs, "")).where(" or ".join(f"size(pii_{k}) > 0" for k in pii.BASE)).count()
    assert before > 0 and after == 0


def test_odd_rows_go_through(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "the house of the rising sun " * 9, None), (4, "the house of the rising sun " * 9, "en"), (5, "12345 !!", "fr"), (6, "x" * 40_000, "de"), (None, "das ist ein Haus", "de")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert {4, None} <= {r.doc_id for r in docs.collect()}


def test_empty_documents_go_through(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_planted_copies_go_and_clean_documents_stay(spark):
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeiou" if i % 2 else "bcdfgklmnprst") for i in range(rng.randint(3, 9))) for _ in range(3000)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = " ".join(make(60))
    rows, copies = [], set()
    for i in range(60):
        words = make(400)
        rows.append((10 * i, " ".join(words)))
        if i % 3 == 0:  # a passage that many share makes no near copy
            rows.append((10 * i + 1, " ".join(make(400)) + " " + passage))
        if i % 4 == 0:
            for k in range(2, 5):
                near = list(words)
                for _ in range(3):
                    near[rng.randrange(400)] = "changed"
                rows.append((10 * i + k, " ".join(near)))
                copies.add(10 * i + k)
            rows.append((10 * i + 5, rows[-1][1]))
            copies.add(10 * i + 5)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, SMALL)
    left = {r.doc_id for r in docs.collect()}
    assert left == {i for i, _ in rows} - copies


def test_names_of_helpers_in_the_input(spark):
    names = ["dedup_path", "dedup_file", "dedup_row", "gone_file", "gone_row", "document", "body", "pii_email", "pii_spans", "pii_text", "score", "mixture", "share", "lang_pred", "near_body", "near_twin", "own_id"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names])
    plain = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        more, plain = stage(spark, more, SMALL), stage(spark, plain, SMALL)
        assert more.columns == [*docs.columns, *names]
        assert {(r.doc_id, r.text) for r in more.collect()} == {(r.doc_id, r.text) for r in plain.collect()}
        assert all(r[n] == f"{n} {r.doc_id}" for r in more.collect() for n in names)


def test_half_a_text_is_enough_for_a_language(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a", None, "s", 1), (2, "b", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(langid, "identify", lambda d, m: d.select("*", F.lit("x:y,z").alias("lang_pred"), F.when(F.col("document.doc_id") == 1, 0.496).otherwise(0.5).alias("share")))
    assert [(r.doc_id, r.lang) for r in corpus_pipeline.language_id(spark, docs, SMALL).collect()] == [(2, "x:y,z")]


def test_what_stages_store_is_deleted(spark):
    import glob

    from docketspark.llm.common import shared_dir

    root = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/docketspark/*"))
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    left = {x.rsplit("/", 1)[1].rsplit("-", 1)[0] for x in set(glob.glob(f"{root}/docketspark/*")) - before}
    assert not left & {"language_id", "exact_dedup", "near_dedup", "content", "dedup", "gone", "members", "alike", "texts"} and "pii" in left
