"""The query language, scores, snippets, highlights, heading merges and lemma phrases."""

import pytest
from pyspark.sql import functions as F

from docketspark.operators import lemma, search
from docketspark.operators.query import Both, Either, Field, Filters, Not, QuerySyntaxError, SearchRequest, Text, condition, merged, parse, score, sections_of
from docketspark.functions.text import legal, normalize_space, snippet


def shape(node):
    match node:
        case Text():
            return node.norm
        case Field():
            return f"{node.field}={node.years or ','.join(node.values)}"
        case Not():
            return f"!{shape(node.part)}"
        case Both():
            return f"({shape(node.left)} & {shape(node.right)})"
        case Either():
            return f"({shape(node.left)} | {shape(node.right)})"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a b", "(a & b)"), ("a OR b c", "(a | (b & c))"), ("a NOT b", "(a & !b)"), ("a and not not b", "(a & !!b)"), ("(a OR b) rok:2020-2018", "((a | b) & year=(2018, 2020))"), ("SĘDZIA:kowalski", "judge=kowalski"),
        ("sekcja:holding", "section=tenor"), ('sekcja:"holding only"', "section=tenor,orzeka,postanawia"), ("art. 32", "art32"), ('typ:wyrok', "decision_type=wyrok"), ('"x y" (z)', "(x y & z)"), ("rok: 2020", "year=(2020, 2020)"),
    ],
)
def test_queries(source, want):
    assert shape(parse(source).tree) == want


@pytest.mark.parametrize("source", ['"a', "(a", "a)", "a AND", "OR a", "foo:x", "rok:20", "sekcja:zzz", "typ:", '""', "()", "NOT"])
def test_bad_queries(source):
    with pytest.raises(QuerySyntaxError):
        parse(source)


def test_empty_query_browses():
    assert parse("  ").tree is None and parse(None).tree is None


def test_names_and_params():
    assert sections_of("uzasadnienie, tenor")[-1] == "tenor" and sections_of("dissent") == ("zdanie_odrebne",)
    assert [t.norm for t in merged(parse("a b"), parse("b NOT c")).texts] == ["a", "b", "c"]
    r = SearchRequest("x rok:2020", Filters(sections=("tenor",), year_from=2001, judge="k"), True)
    assert SearchRequest.from_params(r.to_params()) == r


def rows(spark, *texts, section="uzasadnienie_prawne"):
    df = spark.createDataFrame([(f"p{i}", t, section, 2020) for i, t in enumerate(texts)], "paragraph_id string, text string, section_key string, year int")
    return df.withColumn("text_legal", legal("text"))


def test_scores(spark):
    get = lambda q, t, s: rows(spark, t, section=s).select(score(parse(q))).first()[0]
    assert get('"a b"', "x a b y A B", "uzasadnienie_prawne") == 3.84
    assert get("rok:2020", "x", "tenor") == 1.45
    assert get("zz", "x", "tenor") == 1.45
    assert get("x NOT y", "x y y", "inne") == 3.0


def test_conditions_are_never_null(spark):
    df = spark.createDataFrame([(None, None, None)], "text_legal string, section_key string, year int")
    assert df.select(condition(parse("a OR NOT rok:2020"))).first()[0] is True


def test_snippets(spark):
    cut = lambda t, terms, n: rows(spark, t).select(snippet(normalize_space("text"), F.col("text_legal"), terms, n)).first()[0]
    t = "a " * 150 + "Needle " + "b " * 200
    got = cut(t, ["needle"], 100)
    assert got.startswith("...a a") and got.endswith("...") and len(got) <= 106
    assert cut(t, ["zzz"], 10) == "a a a a a..."
    assert cut("short", ["short"], 100) == "short"


def test_highlights(spark):
    got = search.highlight_ranges("Zażółcie gęś, zazolc", ["zazołc", "ges", "ci"])
    assert [(g["start"], g["end"]) for g in got] == [(0, 8), (9, 12)]
    df = search.with_highlights(rows(spark, "Aą the thesis of the law"), parse('the "of the"'))
    assert df.select(search.marked(F.col("text"), F.col("highlights"))).first()[0] == "Aą <mark>the</mark> <mark>thesis</mark> <mark>of the</mark> law"


def plain_merge(hits):
    out, i = [], 0
    while i < len(hits):
        a, b = hits[i], hits[i + 1] if i + 1 < len(hits) else None
        if b and a["h"] and not b["h"] and a["s"] == b["s"] and b["i"] == a["i"] + 1:
            out.append((b["id"], a["t"]))
            i += 2
        else:
            out.append((a["id"], None))
            i += 1
    return sorted(map(str, out))


def test_heading_merge_equals_a_loop(spark):
    import random

    rng = random.Random(4)
    hits = []
    for i in range(60):
        h = rng.random() < 0.5
        hits.append({"id": f"p{i}", "s": rng.choice(["tenor", "inne"]), "i": i if rng.random() < 0.8 else i + 5, "h": h, "t": f"Ocena {i}:" if h else f"some longer text without an end {i}"})
    df = spark.createDataFrame([("d", x["id"], x["s"], x["i"], x["t"], n) for n, x in enumerate(hits)], "document_id string, paragraph_id string, section_key string, paragraph_index int, text string, hit_rank int")
    assert sorted(str((r.paragraph_id, r.merged_heading)) for r in search.merge_headings(df).collect()) == plain_merge(hits)


def test_phrases(spark):
    found = spark.createDataFrame([("x", "d", "1", 0), ("x", "d", "1", 4), ("y", "d", "1", 5), ("y", "d", "2", 3), ("x", "d", "2", 0)], "lemma string, document_id string, paragraph_id string, pos int")
    forms = spark.createDataFrame([("xs", "x"), ("y", "y")], "form string, lemma string")
    assert [r.paragraph_id for r in lemma.phrase(found, forms, ["xs", "y"]).collect()] == ["1"]
    assert sorted(r.paragraph_id for r in lemma.all_of(found, forms, ["xs", "y"]).collect()) == ["1", "2"]
    assert sorted(r.paragraph_id for r in lemma.all_of(found, forms, ["x"]).collect()) == ["1", "2"]


def test_search_over_an_index(spark):
    df = spark.createDataFrame([("d1", "K 1", "2020-01-01", "p1", "tenor", 2020, "alpha beta"), ("d2", "K 2", "2021-01-01", "p2", "inne", 2021, "alpha"), ("d3", "K 3", "2021-01-01", "p3", "inne", 2021, "gamma")], "document_id string, case_signature string, decision_date_iso string, paragraph_id string, section_key string, year int, text string")
    index = df.withColumn("text_legal", legal("text"))
    assert [r.document_id for r in search.search(index, SearchRequest("alpha")).collect()] == ["d1", "d2"]
    assert [r.document_id for r in search.search(index, SearchRequest("", Filters(year_from=2021))).collect()] == ["d2", "d3"]
