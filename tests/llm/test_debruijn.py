"""Repeated passages against SQL and against counting all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from docketspark.llm import debruijn, registry
from tests.oracle import duck, spark_rows


def plain(rows, k):
    """{(doc_id, text): (n_words, n_removed, kept)} by counting windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), left))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def random_texts(rng, n=60):
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(40)) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            b = rng.choice(base).split()
            a = rng.randint(0, 39)
            parts += b[a : a + rng.randint(1, 40)] if rng.random() < 0.7 else [rng.choice("xyzuvw") * rng.randint(1, 3) for _ in range(rng.randint(1, 20))]
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize("k,hot", [(2, 30_000), (5, 30_000), (12, 30_000), (12, 3)])
def test_removed_words_equal_counted_windows(spark, monkeypatch, k, hot):
    monkeypatch.setattr(debruijn, "HOT", hot)
    rng = random.Random(k)
    rows = list(enumerate(random_texts(rng)))
    rows += [(None, rows[3][1]), (900, None), (901, ""), (902, " \t\n"), (903, "a " * 300), (904, "a b " * 200), (905, "a b " * 190), (3, rows[3][1]), (3, rows[3][1]), (906, "é中 " * 3 + "\x85\xa0 q")]
    rows += [(2000 + i, "the very same passage that all of them have in common and that is long " + str(i)) for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, kept string")
    texts, spans = debruijn.remove_repeats(df, k)
    assert got(texts) == plain(rows, k)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in texts.collect())


def test_nonbranching_paths_are_compacted(spark):
    """A passage that several texts share is one path, whatever surrounds it, and each place of it a span on that path."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(400)]
    rows = [(i, " ".join([word() for _ in range(20)] + passage + [word() for _ in range(30)])) for i in range(4)]
    rows += [(4, " ".join(passage[100:300])), (5, " ".join(passage[:60] + [word() for _ in range(60)]))]
    texts, spans = debruijn.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 35)
    found = spans.collect()
    assert len({r.path for r in found}) == 1
    # Every edge of a text lies on the path where its passage's word lies.
    for r in found:
        offset = 20 if r.id < 4 else -100 if r.id == 4 else 0
        assert r.at == r.start - offset
    assert sum(r.n for r in found if r.id == 0) == 366
    assert {r.doc_id: r.n_removed for r in texts.collect()} == {0: 400, 1: 400, 2: 400, 3: 400, 4: 200, 5: 60}


def test_branching_nodes_end_paths(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    a, b, c = ([word() for _ in range(80)] for _ in range(3))
    rows = [(0, " ".join(a + b)), (1, " ".join(a + b)), (2, " ".join(a + c)), (3, " ".join(a + c))]
    _, spans = debruijn.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 35)
    found = spans.collect()
    assert len({r.path for r in found}) == 3
    assert sorted({(r.start, r.start + r.n) for r in found if r.id == 0}) == [(0, 46), (46, 126)]


def test_sources_that_leave_a_path_and_come_back(spark):
    """A near copy's changed word repeats in another text only: the path goes on where the first text, the source, leaves it."""
    rng = random.Random(4)
    a = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    b = [*a[:150], "changed", *a[151:]]
    rows = [(0, " ".join(a)), (1, " ".join(b)), (2, " ".join(b))]
    texts, spans = debruijn.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 35)
    assert got(texts) == plain(rows, 35)
    assert sorted({(r.start, r.n, r.source_id) for r in spans.collect() if r.id == 2}) == [(0, 116, 0), (116, 35, 1), (151, 115, 0)]


def test_spans_that_differ_from_their_source_are_found(spark, monkeypatch):
    rows = [(0, " ".join(f"w{i}" for i in range(60))), (1, " ".join(f"w{i + 17}" for i in range(60))), (2, " ".join(f"v{i}" for i in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = debruijn.keyed(df, "doc_id", "text")
    places = debruijn.spans(own, 12, debruijn.SEEDS[0])
    shifted = places.withColumn("source_start", places.source_start + (places.id != places.source_id).cast("int"))
    assert not debruijn.unequal(places, debruijn.kept_texts(own, places, 12, False))
    assert debruijn.unequal(shifted, debruijn.kept_texts(own, shifted, 12, False))
    monkeypatch.setattr(debruijn, "unequal", lambda s, d: True)
    with pytest.raises(RuntimeError):
        debruijn.remove_repeats(df, 12)


def test_empty_table(spark):
    texts, spans = debruijn.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 35)
    assert texts.collect() == [] and spans.collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf):
    assert spark_rows(registry.op12_debruijn_repeats(spark, sf)) == duck(registry.ORACLES["op12_debruijn_repeats"], sf)
