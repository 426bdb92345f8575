"""One-scan lemma searches against the joins, and samples against a shuffle from the end."""

import random

import pytest
from pyspark.sql import functions as F

from docketspark.operators import lemma, phrases, sampling
from docketspark.operators.query import parse


def generator(seed):
    """Numbers in [0, 1) one after the other, in 32-bit arithmetic."""
    t = seed
    while True:
        t = (t + 0x6D2B79F5) % 2**32
        r = (t ^ t >> 15) * (t | 1) % 2**32
        r ^= (r + (r ^ r >> 7) * (r | 61)) % 2**32
        yield (r ^ r >> 14) / 2**32


def shuffled(total, n, seed):
    """The first n places of a shuffle from the end."""
    own, numbers = list(range(total)), generator(seed)
    for i in range(total - 1, 0, -1):
        j = int(next(numbers) * (i + 1))
        own[i], own[j] = own[j], own[i]
    return sorted(own[: min(n, total)])


def test_numbers_of_the_generator(spark):
    # Known values of seed 0 and of a large one.
    assert [next(g) for g in [generator(0)] for _ in range(2)] == [0.26642920868471265, 0.0003297457005828619]
    for seed in (0, 20, 0xFFFFFFFF, sampling.seed_of("abc12345ff"), sampling.seed_of("")):
        want = [x for x, _ in zip(generator(seed), range(300))]
        got = [r.x for r in spark.range(300).select("id", sampling.uniform(seed, F.col("id")).alias("x")).orderBy("id").collect()]
        assert got == want


@pytest.mark.parametrize("total,n", [(0, 5), (1, 1), (7, 50), (50, 50), (51, 50), (1000, 50), (3000, 1)])
def test_places_equal_a_shuffle(spark, total, n):
    for seed in (1, 20):
        assert sorted(r.place for r in sampling.places(spark, total, n, seed).collect()) == shuffled(total, n, seed)


def test_sample_of_rows(spark):
    rows = spark.createDataFrame([(f"id{i:04}", i) for i in range(700)], "id string, x int").repartition(5)
    assert sorted(r.x for r in sampling.sample(rows, "id", 20, 7).collect()) == shuffled(700, 20, 7)


WORDS = ["kot", "koty", "pies", "psy", "dom", "art", "art32", "a-b", "ma"]
QUERIES = ["kot", '"koty ma"', '"ma ma" OR dom', 'pies NOT "kot kot"', "(psy OR dom) koty", '"kot ma psy" AND dom', '"unknown word"', "unknown"]


def corpus(spark):
    rng = random.Random(3)
    rows = [(f"p{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))) for i in range(250)] + [("empty", ""), ("null", None), ("long", "ma " * 5000 + "ma kot")]
    df = spark.createDataFrame(rows, "paragraph_id string, text string")
    return df.withColumns({"document_id": F.lit("d"), "section_key": F.lit("inne"), "text_legal": F.coalesce("text", F.lit(""))})


@pytest.mark.parametrize("source", QUERIES)
def test_one_scan_equals_joins(spark, source):
    index = corpus(spark)
    table = spark.createDataFrame([("koty", "kot"), ("psy", "pies"), ("psy", "psa"), ("ma", "miec"), ("ma", "maj"), ("maj", "maj")], "form string, lemma string")
    seen = lemma.occurrences(index)
    known = lemma.forms(seen, table)
    want = sorted((r.paragraph_id, r.score) for r in lemma.search(index, lemma.positions(seen, known), known, parse(source)).collect())
    got = sorted((r.paragraph_id, r.score) for r in phrases.search(index, parse(source), known).collect())
    assert got == want


def test_plan_is_one_scan_without_shuffles(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "i"))
    out = phrases.search(spark.read.parquet(str(tmp_path / "i")), parse('kot "ma psy" NOT dom'), lambda w: F.substring(w, 1, 3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Generate" not in plan
    many = [[w, x] for w in WORDS for x in WORDS]  # more words than bits of a mask
    text = F.array(*map(F.lit, ["kot", "koty", "pies", "dom"]))
    found = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(phrases.seen(text, many, phrases.tests_of(WORDS, None)[1]))]).first()
    assert [p for p, hit in zip(many, found) if hit] == [["kot", "koty"], ["koty", "pies"], ["pies", "dom"]]


def packable(spark):
    """Keys that repeat or are null, words that repeat, texts without words."""
    rows = [(1, "a", "kota pies kota, kot"), (1, "b", ""), (1, "c", None), (2, "a", "-- las"), (2, "a", "las kotom las"), (None, None, "pies"), (None, None, "las pies"), (3, "d", "dom " * 300 + "kot")]
    return spark.createDataFrame(rows, "document_id int, paragraph_id string, text string")


def test_lemmas_packed_within_rows_equal_packed_places(spark):
    rows, of = packable(spark), lambda x: F.substring(x, 1, 3)
    found = lemma.occurrences(rows).select(*lemma.KEY, "pos", of("form").alias("lemma"))
    plain = lambda df: sorted(map(repr, df.collect()))
    made = lemma.packed_rows(rows, of)
    assert plain(made.select("lemma", *lemma.KEY, "positions")) == plain(lemma.packed(found).select("lemma", *lemma.KEY, "positions"))
    assert lemma.packed_rows(rows.limit(0), of).count() == 0


def test_distinct_lemmas_of_rows_equal_postings(spark):
    rows, of = packable(spark), lambda x: F.substring(x, 1, 3)
    found = lemma.occurrences(rows).select(*lemma.KEY, "pos", of("form").alias("lemma"))
    own = lemma.lemmas_of(rows, of)
    plain = lambda df: sorted(map(repr, df.select("lemma", *lemma.KEY).collect()))
    assert plain(own.distinct()) == plain(lemma.postings(found))
    assert own.where("document_id = 3").count() == 2
