"""Scalar functions and classification rules on hand-made values."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from docketspark.functions import classify, scalars, text


def value(spark, column, *rows):
    names = [f"c{i}" for i in range(len(rows[0]))]
    return [r[0] for r in spark.createDataFrame(list(rows), names).select(column(*map(F.col, names))).collect()]


def one(spark, column, *args):
    return value(spark, column, args)[0]


def test_folds(spark):
    assert value(spark, text.fold_search, ("Zażółć  GĘŚLĄ",)) == ["zazołc gesla"]
    assert value(spark, text.fold_build, ("Zażółć  GĘŚLĄ",)) == ["zazolc gesla"]
    assert value(spark, text.legal, ("Art. 32 ust. 1",), ("a§5",), ("ęart 5",)) == ["art32 ust. 1", "a § 5", "eart 5"]
    rng = random.Random(1)
    letters = [chr(c) for c in range(0xC0, 0x250) if unicodedata.category(chr(c))[0] == "L"]
    rows = [("".join(rng.choice(letters) for _ in range(20)),) for _ in range(50)]
    assert value(spark, text.fold_search, *rows) == [text.fold_plain(r[0]) for r in rows]


def test_dates(spark):
    get = lambda s: one(spark, scalars.parse_date, s)["iso"]
    assert [get(s) for s in ("1.2.2020", "3 września 2019", "2018-05-07", "31.02.2020", "maj 2020", "")] == ["2020-02-01", "2019-09-03", "2018-05-07", "2020-02-31", None, None]
    assert one(spark, scalars.parse_date, "1.2.2020")["year"] == 2020
    assert value(spark, scalars.format_date, ("2019-09-03",), ("x",)) == ["3 września 2019", "brak daty"]
    assert value(spark, scalars.to_timestamp_ms, ("1970-01-02",), ("x",)) == [86_400_000, 0]


def test_benches_and_types(spark):
    bench = lambda n: (lambda r: (r["b"]["key"], classify_official(spark, r["b"]["key"])))(spark.createDataFrame([(n,)], "n int").select(classify.bench(F.col("n")).alias("b")).first())
    assert [bench(n)[0] for n in (11, 15, 5, 3, 7, 0)] == ["pelny_sklad", "pelny_sklad", "piecioosobowa", "trojosobowa", "7_osobowa", "nieustalony"]
    assert bench(7)[1] == "poza_klasyfikacja_ipo"
    kinds = [one(spark, classify.decision_type, s) for s in ("Postanowienie tymczasowe", "Postanowienie - umorzenie", "Wyrok", "Uchwała")]
    assert [k["key"] for k in kinds] == ["postanowienie_tymczasowe", "postanowienie", "wyrok", None] and not kinds[3]["visible"]


def classify_official(spark, key):
    return one(spark, classify.official_bench, key)["key"]


def test_sections(spark):
    rows = {"Zdanie odrębne X": "zdanie_odrebne", "Orzeka": "orzeka", "Umorzyć postępowanie": "postanawia", "Uzasadnienie - część historyczna": "uzasadnienie_historyczne", "Uzasadnienie": "uzasadnienie_ogolne", "Część na rozprawie": "uzasadnienie_postepowanie", "xyz": "inne", "": "inne"}
    assert value(spark, classify.section_of, *[(k,) for k in rows]) == list(rows.values())


def test_roman_map(spark):
    toc = [("II - Uzasadnienie: część historyczna",), ("I. Tenor",), ("III Inne",), ("I Komparycja",)]
    df = spark.createDataFrame([(toc,)], "toc array<struct<text:string>>")
    assert df.select(classify.roman_map(F.col("toc"))).first()[0] == {"II": "uzasadnienie_historyczne", "I": "komparycja"}
    keys = df.select(classify.resolve_section(F.lit("II"), classify.roman_map(F.col("toc"))).alias("r")).first()["r"]
    assert (keys["key"], keys["confidence"]) == ("uzasadnienie_historyczne", 0.90)


def test_citations(spark):
    rows = {"art. 32 ust. 1 Konstytucji oraz Art. 2": ["art. 32 ust. 1", "art. 2"], "art. 5 § 2 pkt 1": ["art. 5 § 2 pkt 1"], "§ 3": ["§ 3"], "kart 7 i § 3": ["art. 7"], "nic": []}
    assert value(spark, scalars.citations, *[(k,) for k in rows]) == list(rows.values())


def test_numbers(spark):
    f = lambda a, b: spark.createDataFrame([(a, b)], "a int, b int").select(scalars.year_proximity(F.col("a"), F.col("b"))).first()[0]
    assert (f(2000, 2010), f(2000, 2030), f(None, 2000)) == (0.5, 0.0, 0.0)
    j = lambda a, b: spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(scalars.jaccard(F.col("a"), F.col("b"))).first()[0]
    assert (j([1, 2], [2, 3]), j([], [1])) == (1 / 3, 0.0)
    assert value(spark, lambda n: text.plural(n, "a", "b", "c"), (1,), (2,), (12,), (22,), (25,)) == ["a", "b", "c", "b", "c"]


def test_csv_and_html(spark):
    assert value(spark, text.csv_field, ("a,b",), ('a"b',), (None,), ("a\rb",)) == ['"a,b"', '"a""b"', "", "a\rb"]
    assert value(spark, text.escape_html, ("<a b='1'>&",)) == ["&lt;a b=&#39;1&#39;&gt;&amp;"]
    assert value(spark, text.slug, ("Śąd — 12/3 ",)) == ["sad-12-3"]


@pytest.mark.parametrize(
    ("url", "case", "document", "want"),
    [("x", "1", "2", "https://ipo.trybunal.gov.pl/ipo/Sprawa?dokument=2&sprawa=1"), (" http://a.b ", None, None, "http://a.b"), ("https://ipo.trybunal.gov.pl/ipo/Sprawa?cid=3&dokument=7&sprawa=8", None, None, "https://ipo.trybunal.gov.pl/ipo/Sprawa?dokument=7&sprawa=8"), ("", None, None, None)],
)
def test_urls(spark, url, case, document, want):
    df = spark.createDataFrame([(url, case, document)], "u string, c string, d string")
    assert df.select(scalars.canonical_url("u", F.col("c"), F.col("d"))).first()[0] == want


def test_dissent_judge(spark):
    assert value(spark, scalars.dissent_judge, ("Zdanie odrębne sędziego TK Jana Kowalskiego do wyroku",), ("Inny nagłówek",)) == ["Jana Kowalskiego", "Inny nagłówek"]
