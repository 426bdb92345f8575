"""Raw decisions to cases, the walks along paragraphs, files in and out, the streaming extension."""

import json

import pytest
from pyspark.sql import functions as F

from docketspark.operators import lemma, normalize, records, search
from docketspark.operators.query import SearchRequest
from docketspark.sources import artefacts
from docketspark.sources import cases as sources
from docketspark.sources import sinks
from docketspark.streaming import ingest


def paragraph(key, text="x", raw=None):
    return dict.fromkeys(normalize.FIELDS) | {"section_key": key, "text": text, "section_raw": raw, "section_confidence": 0.35}


def keys(rows, kind="Wyrok", forced=False):
    return [(p["section_key"], p["section_confidence"], p["section_reclass_reason"]) for p in normalize.walk_paragraphs(rows, kind, forced)]


def test_bridge_and_order_of_decisions():
    assert keys([paragraph("orzeka"), paragraph("inne"), paragraph("orzeka")])[1] == ("orzeka", 0.95, "bridged-between-same-sections")
    # The second unknown paragraph sees what the first has just become.
    rows = [paragraph("tenor")] + [paragraph("uzasadnienie_prawne", "q")] * 2 + [paragraph("inne", "oraz dalej"), paragraph("inne", "oraz jeszcze")]
    assert [k[0] for k in keys(rows)][3:] == ["uzasadnienie_prawne"] * 2
    assert keys([paragraph("inne", "Zdanie odrębne sędziego")])[0][:2] == ("zdanie_odrebne", 0.98)
    assert keys([paragraph("inne", "nic"), *[paragraph("inne", "nic")] * 9])[5][0] == "inne"
    assert [k[0] for k in keys([paragraph("inne", "nic")] * 10, forced=True)][0] == "tenor"
    assert "inne" not in {k[0] for k in keys([paragraph("inne", "nic")] * 10, forced=True)}


def test_dissent_merge():
    texts = ["sędziego TK Jana Kowalskiego", "do wyroku Trybunału", "z dnia 1 maja 2020 r.", "Nie zgadzam się"]
    got = normalize.merge_dissent([paragraph("zdanie_odrebne", t) for t in texts])
    assert [p["text"] for p in got] == ["Zdanie odrębne sędziego TK Jana Kowalskiego do wyroku Trybunału z dnia 1 maja 2020 r.", "Nie zgadzam się"]


def test_dissent_merge_by_windows_equals_the_walk(spark):
    import random

    rng = random.Random(6)
    pool = ["sędziego TK Jana", "do wyroku", "z dnia 1 maja", "sygn. K 1", "Nie zgadzam się", "do " + "x" * 300]
    rows, want = [], []
    for d in range(60):
        ps = [paragraph(rng.choice(["zdanie_odrebne"] * 4 + ["inne"]), rng.choice(pool)) for _ in range(rng.randint(1, 9))]
        rows += [(d, i, p["section_key"], p["text"]) for i, p in enumerate(ps)]
        want += [(d, p["text"]) for p in normalize.merge_dissent(ps)]
    df = spark.createDataFrame(rows, "document_id int, pos int, section_key string, text string")
    got = normalize.merge_dissent_headings(df, "document_id", "pos").collect()
    assert sorted((r.document_id, r.text) for r in got) == sorted(want)


RAW = [
    {
        "ids": {"case_id": "5", "document_id": "9"}, "case_signature": "K 1/20", "decision_type": "Wyrok", "topic": "Prawo do sądu", "decision_date": "3 września 2019",
        "judges": [{"name": "A"}, {"name": "B"}, {"name": " "}, {"name": "A"}], "table_of_contents": [{"text": "II - Uzasadnienie: część historyczna"}],
        "paragraphs": [{"text": "Czy art. 5 jest zgodny", "section": "", "paragraph_number": "1"}, {"text": " "}, {"text": "historia sprawy", "section": "II"}, {"text": "Trybunał orzeka", "section": "Orzeka"}],
    },
    {"ids": {"document_id": "10"}, "case_signature": "K 2/20", "decision_type": "Uchwała", "decision_date": "maj 2020", "paragraphs": []},
]


@pytest.fixture
def raw(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps(RAW, indent=1))
    (tmp_path / "lines.jsonl").write_text("\n\n".join(map(json.dumps, RAW)) + "\n")
    return tmp_path


def test_reading_either_layout(spark, raw):
    for name in ("array.json", "lines.jsonl"):
        assert sources.load_raw(spark, f"{raw}/{name}").count() == 2


def test_normalized_cases(spark, raw):
    over = spark.createDataFrame([("10", "pelny_sklad"), ("9", "no such")], "document_id string, bench string")
    out = {r.document_id: r for r in normalize.cases(sources.load_raw(spark, f"{raw}/lines.jsonl"), over).collect()}
    a, b = out["9"], out["10"]
    assert (a.decision_date_iso, a.year, a.judge_count, a.bench_size_ipo_key, a.decision_type_ipo_key) == ("2019-09-03", 2019, 3, "trojosobowa", "wyrok")
    assert [(p.paragraph_id, p.section_key) for p in a.paragraphs] == [("9-1", "tenor"), ("9-3", "uzasadnienie_historyczne"), ("9-4", "orzeka")]
    assert a.source_url.endswith("dokument=9&sprawa=5") and a.section_counts == {"tenor": 1, "uzasadnienie_historyczne": 1, "orzeka": 1}
    assert b.bench_size_ipo_key == "pelny_sklad" and b.decision_date_iso is None and b.paragraph_count == 0
    full, empty = normalize.nonempty(normalize.cases(sources.load_raw(spark, f"{raw}/lines.jsonl")))
    assert (full.count(), empty.count()) == (1, 1)


def test_reader_profile(spark, raw):
    out = {r.document_id: r for r in normalize.cases(sources.load_raw(spark, f"{raw}/lines.jsonl"), reader=True).collect()}
    assert [(p.section_key, p.section_confidence) for p in out["9"].paragraphs] == [("tenor", 0.72), ("uzasadnienie_historyczne", 0.88), ("orzeka", 0.95)]
    assert out["10"].year == 2020 and out["10"].decision_date_iso is None


def test_index_search_and_lemma_files(spark, raw):
    cases = normalize.nonempty(normalize.cases(sources.load_raw(spark, f"{raw}/lines.jsonl")))[0]
    index = search.paragraph_index(cases)
    assert search.search(index, SearchRequest("art. 5 sygn:k")).count() == 1
    lemma.write_index(index, f"{raw}/index", "h1", lemmatize=lambda form: [form[:4] + ":x"])
    assert lemma.read_index(spark, f"{raw}/index", "other") is None
    found, forms = lemma.read_index(spark, f"{raw}/index", "h1")
    from docketspark.operators.query import parse

    assert [r.paragraph_id for r in lemma.search(index, found, forms, parse('"historia sprawy"')).collect()] == ["9-3"]


def test_sinks(spark, raw):
    cases = sinks.stamped(normalize.cases(sources.load_raw(spark, f"{raw}/lines.jsonl")), "h")
    sinks.write_cases(cases, f"{raw}/out", samples=(1,))
    assert sources.load_cases(spark, f"{raw}/out/full").where("dataset_hash = 'h'").count() == 2
    assert spark.read.json(f"{raw}/out/sample1").count() == 1
    df = spark.createDataFrame([(1, 'a,"b"'), (2, None)], "id int, t string")
    sinks.write_csv(df, f"{raw}/csv")
    assert sorted(r[0] for r in spark.read.text(f"{raw}/csv").collect()) == ['1,"a,""b"""', "2,", "id,t"]
    assert sinks.dataset_hash(df) == sinks.dataset_hash(df.orderBy(F.col("id").desc())) != sinks.dataset_hash(df.where("id = 1"))
    stamp = sinks.with_provenance(df, query="q", filters={"b": "1", "a": "2"}, digest="h", generated_at="now").first()
    assert stamp.filters == '{"a":"2","b":"1"}' and stamp.id == 1
    assert json.loads(sinks.dossier("q", {}, "note", df, df).first()[0])["notes"] == "note"
    assert sources.files(spark, str(raw), ["*.json", "*.jsonl"]).count() >= 2
    with pytest.raises(FileNotFoundError):
        sources.files(spark, str(raw), ["*.nothing"])
    assert sources.bench_overrides(spark, f"{raw}/missing.json").count() == 0
    (raw / "bench.json").write_text(json.dumps({"by_document_id": {" 9 ": "pelny_sklad", "1": "other"}}))
    assert [tuple(r) for r in sources.bench_overrides(spark, f"{raw}/bench.json").collect()] == [("9", "pelny_sklad")]


def test_predictions(spark):
    import pandas as pd

    df = spark.createDataFrame([(f"p{i}", "inne") for i in range(5)], "paragraph_id string, section_key string")
    said = normalize.predict(df, lambda b: pd.DataFrame({"paragraph_id": b["paragraph_id"], "predicted_section_key": "tenor", "confidence": 0.9, "reason": "r"}), batch=2)
    assert {r.section_key for r in normalize.merge_predictions(df, said).collect()} == {"tenor"}


def test_streaming_ingest(spark, raw):
    (raw / "in").mkdir()
    for i in range(2):
        (raw / "in" / f"{i}.jsonl").write_text("\n".join(map(json.dumps, RAW)) + "\n")
    q = ingest.ingest(spark, f"{raw}/in", f"{raw}/stream", f"{raw}/ck")
    q.awaitTermination()
    assert spark.read.parquet(f"{raw}/stream").count() == 2


def test_repaired_cases(spark, raw):
    full = sinks.stamped(normalize.nonempty(normalize.cases(sources.load_raw(spark, f"{raw}/lines.jsonl")))[0], "h")
    once = records.sanitized(full)
    drop = "dataset_generated_at"  # the clock
    assert records.sanitized(once).drop(drop).collect() == once.drop(drop).collect()
    r = once.first()
    assert (r.year, r.bench_size_ipo_key, len(r.paragraphs)) == (2019, "trojosobowa", 3)
    bare = full.withColumns({"year": F.lit(None).cast("int"), "decision_date_iso": F.lit(None).cast("string"), "bench_size_ipo_key": F.lit("")})
    assert records.sanitized(bare).first().year == 2019
    early = full.withColumn("paragraphs", F.transform("paragraphs", lambda p: p.withField("section_key", F.lit("inne")).withField("section_label", F.lit("Inne"))))
    p = records.sanitized(early).first().paragraphs[0]
    assert (p.section_key, p.section_label) == ("tenor", "Inne")
    assert full.select(records.is_normalized(F.col("paragraphs"))).first()[0]
    figures = records.key_figures(full).first()
    assert (figures.cases, figures.paragraphs) == (1, 3)


def test_citations_and_exports(spark):
    row = ("d", "K 1/20 **", "Wyrok", "2019-09-03", "x", [("OTK ZU A/2016, poz. 3.",)], "p1", 4, None, "tenor", "Tenor", "text", 1.45, 0, None)
    df = spark.createDataFrame([row], "document_id string, case_signature string, decision_type string, decision_date_iso string, decision_date_raw string, publication_entries array<struct<text:string>>, paragraph_id string, paragraph_index int, paragraph_number string, section_key string, section_label string, text string, score double, place int, source_url string")
    assert df.select(records.paragraph_citation()).first()[0] == "wyrok TK z dnia 3 września 2019 r., K 1/20, OTK ZU 2016, nr A, poz. 3, Tenor, § 4"
    stamp = {"query": "q", "filters": {}, "digest": "h", "generated_at": "now"}
    assert len(records.search_export(df, **stamp).columns) == 18 and len(records.quote_export(df, df, **stamp).columns) == 20
    assert records.quote_export(df, df, **stamp).count() == 1
    assert df.withColumn("publication_entries", F.array().cast("array<struct<text:string>>")).withColumn("decision_date_iso", F.lit(None).cast("string")).select(records.citation()).first()[0] == "wyrok TK z dnia x r., K 1/20"


def test_metrics(spark):
    acts = "array(named_struct('act','A','items',array('i')),named_struct('act','B','items',array()),named_struct('act','C','items',array()),named_struct('act','D','items',array()))"
    df = spark.sql(f"select named_struct('wzorce', named_struct('present', true, 'text', 'Tęxt', 'items', array('j'), 'acts', {acts})) case_metric, map('Wzorce', 'meta') metadata")
    r = df.select(records.metric("wzorce", "Wzorce").alias("m"), records.standard().alias("s")).first()
    assert (r.m.preview, r.s) == ("A; B; C (+1)", "text j a i b c d")
    none = spark.sql(f"select named_struct('wzorce', named_struct('present', false, 'text', '', 'items', array('j'), 'acts', {acts})) case_metric, map('Wzorce', 'Meta') metadata")
    assert none.select(records.standard()).first()[0] == "meta"


def test_artefacts(spark, tmp_path):
    sets = artefacts.Datasets({"full": str(tmp_path / "full")})
    row = {"document_id": "1", "target_document_id": "2", "case_signature": "K", "dataset_hash": "h", "schema_version": "v1"}
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "similar").write_text(json.dumps(row) + "\n" + json.dumps(row | {"target_document_id": ""}) + "\n")
    get = lambda h, v: artefacts.first_fitting(spark, sets.candidates("full", "similar"), artefacts.SIMILAR, h, v)
    rows, why = get("h", ["v1"])
    assert why == "" and [(r.target_document_id, r.score, r.components.lexical) for r in artefacts.similar(rows).collect()] == [("2", 0.0, 0.0)]
    assert "another dataset" in get("x", ["v1"])[1] and "version" in get("h", ["v2"])[1] and sets.candidates("mine", "similar") == []
    with pytest.raises(KeyError):
        sets.path("mine")


def test_lemma_highlights(spark):
    from docketspark.operators.query import parse

    df = spark.createDataFrame([("d", "p", "Ala ma koty, ma psy")], "document_id string, paragraph_id string, text string")
    seen = lemma.occurrences(df)
    known = lemma.forms(seen, spark.createDataFrame([("koty", "kot")], "form string, lemma string"))
    got = lemma.highlights(df, lemma.positions(seen, known), known, parse('"ma koty"')).collect()
    assert sorted((r.start, r.end) for r in got) == [(4, 6), (7, 11)]
    assert lemma.search_or_plain(df.withColumns({"section_key": F.lit("inne"), "text_legal": F.lower("text")}), None, parse("koty")).count() == 1


def test_bigram_jaccard_all_against_brute_force(spark):
    from collections import Counter

    from docketspark.plans.catalogue import queries

    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()
    terms = {r.p_partkey: Counter([r.p_name, f"{r.p_brand} {r.p_size % 10}", r.p_type]) for r in parts}
    want = {}
    for a in terms:
        for b in terms:
            both = (terms[a] & terms[b]).total()
            if a < b and both:
                want[a, b] = round(both / (6 - both), 6)
    got = {(r.a, r.b): r.value for r in queries()["bigram_jaccard_all"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and 0.2 in got.values()


def test_forced_reasons():
    """One paragraph for each way of the forced pass."""
    plain = lambda n: [paragraph("inne", "nic") for _ in range(n)]
    reasons = lambda rows, kind="Wyrok": [k[2] for k in keys(rows, kind, True)]
    assert reasons(plain(10))[0] == "forced:early-default-tenor"
    assert reasons(plain(10), "Postanowienie")[0] == "forced:early-postanowienie"
    assert reasons([paragraph("inne", "głos sędziego TK Nowaka")])[0] == "forced:dissent-lexical"
    far = [paragraph("komparycja", "x"), *plain(12), paragraph("zdanie_odrebne", "y")]
    assert "forced:nearest-neighbor" in reasons(far)
    tail = [paragraph("komparycja", "x"), *plain(1)]
    assert reasons(tail)[1] == "forced:prev-neighbor"
    assert reasons([paragraph("inne", "nic"), paragraph("komparycja", "x")])[0] == "forced:next-neighbor"


def test_review_report(spark):
    raw = spark.createDataFrame([("d1", "K 1", [("p1", 1, "zdanie_odrebne", "Zdanie odrębne", 0.98, "inne", "dissent-heading", "a"), ("p2", 2, "tenor", "Tenor", 0.9, None, None, "b"), ("p3", 3, "tenor", "Tenor", 0.65, "inne", "forced:early-default-tenor", "c")])],
        "document_id string, case_signature string, paragraphs array<struct<paragraph_id:string,paragraph_index:int,section_key:string,section_label:string,section_confidence:double,section_reclassified_from:string,section_reclass_reason:string,text:string>>")
    raw = raw.withColumn("paragraphs", F.transform("paragraphs", lambda p: p.withField("paragraph_number", F.lit(None).cast("string"))))
    report = normalize.review(raw)
    assert sorted((r.paragraph_id, r.source_section_key, r.predicted_section_key, r.reason, r.model, r.text) for r in report.collect()) == [("p1", "inne", "zdanie_odrebne", "dissent-heading", None, "a"), ("p3", "inne", "tenor", "forced:early-default-tenor", "forced-fallback", "c")]
    assert sorted((str(r.model), r.predicted_section_key, r.n) for r in normalize.review_counts(report).collect()) == [("None", "zdanie_odrebne", 1), ("forced-fallback", "tenor", 1)]
    assert normalize.prompt().count("{") == 2 and "komparycja, tenor" in normalize.prompt()


def test_shards_of_many_terms(spark):
    from docketspark.operators import lemma

    terms = spark.range(400_000).select(F.concat(F.lit("t"), F.col("id")).alias("term"))
    got = sorted(lemma.shards(terms, "term", 1000).collect())
    names = sorted(f"t{i}" for i in range(400_000))
    assert [tuple(r) for r in got] == [(i, names[1000 * i], names[1000 * i + 999], 1000) for i in range(400)]


def test_flat_root_covers_all_leaves_at_any_size(spark):
    import hashlib

    from docketspark.sources import merkle

    n = merkle.WIDTH * merkle.WIDTH + 300  # more leaves than one node of the tree covers
    rows = spark.range(n).withColumn("d", F.sha2(F.col("id").cast("string"), 256))
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    leaf = lambda k: hashlib.sha256("".join(map(digest, range(k, min(k + merkle.WIDTH, n)))).encode()).hexdigest()
    want = hashlib.sha256("".join(map(leaf, range(0, n, merkle.WIDTH))).encode()).hexdigest()
    assert [r.digest for r in merkle.flat_root(merkle.leaves(rows, "id", F.col("d"))).collect()] == [want]
    assert merkle.tree_hash(rows, "id", F.col("d")) != want
    assert [r.digest for r in merkle.flat_root(merkle.leaves(rows.limit(0), "id", F.col("d"))).collect()] == [merkle.EMPTY]
