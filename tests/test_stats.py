"""Bigrams: counts and last labels."""

from docketspark.operators import stats


def test_bigrams_are_shuffled_once(spark, capsys):
    rows = spark.createDataFrame([(1, 1, "Żółta łódka płynie"), (1, 2, "zolta lodka tonie"), (2, 1, "ŻÓŁTA lódka tonie żółta łodka")], "doc_id long, pos long, text string")
    found = stats.bigrams(rows, "text", ["doc_id", "pos"])
    said = {r.key: (r.label, r.n) for r in found.collect()}
    assert said["zolta lodka"] == ("żółta łodka", 4)
    assert said["lodka tonie"] == ("lódka tonie", 2)
    found.explain()
    assert capsys.readouterr().out.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_lines_are_folded_once(spark):
    """A line's white space is looked through once, whatever is made of its text."""
    from docketspark.functions import dims, text
    from docketspark.plans.registry import lines

    rows = lines(spark, "/root/testdata/sf0.001")
    for made in (text.lemma_tokens("text", spaced=True), text.surface_tokens("text", dims.BIGRAM_STOPWORDS, spaced=True), text.tokens("text", spaced=True)):
        plan = rows.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"(?U)\s(?:") == 1
    odd = spark.createDataFrame([(i, x) for i, x in enumerate([None, "", " \t ", " a  b ", "  -- Żó  art. 32a §1 "])], "i int, raw string")
    once = odd.select("i", text.normalize_space("raw").alias("text"))
    for f in (text.lemma_tokens, text.tokens, text.legal, text.fold_build):
        assert once.select(f("text", spaced=True).alias("x")).collect() == odd.select(f("raw").alias("x")).collect()
