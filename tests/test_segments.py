"""A lemma index after additions, removals and merges against one that is built anew."""

import random

import pytest
from pyspark.sql import functions as F

from docketspark.operators import lemma, segments


def paragraphs(spark, rng, ids):
    words = ["kot", "pies", "dom", "las", "art"]
    rows = [(f"d{i}", f"d{i}-{k}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in ids for k in range(2)]
    return spark.createDataFrame(rows, "document_id string, paragraph_id string, text string")


def plain(df):
    return sorted((r.form[:2], r.document_id, r.paragraph_id, r.pos) for r in lemma.occurrences(df).collect())


def held(spark, path):
    return sorted((r.lemma, r.document_id, r.paragraph_id, r.pos) for r in segments.positions(spark, path).collect())


def test_additions_removals_and_merges_equal_a_rebuild(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "i")
    of = lambda x: F.substring(x, 1, 2)
    with pytest.raises(ValueError):
        segments.positions(spark, path)
    now = {}
    for step in range(5):
        ids = [f for f in range(step * 3, step * 3 + 5)]  # some come again
        again = spark.createDataFrame([(f"d{i}",) for i in ids], "document_id string")
        if step:
            segments.remove(spark, path, again)
        part = paragraphs(spark, rng, ids)
        segments.add(spark, path, part, of)
        now |= {i: part.where(F.col("document_id") == f"d{i}").collect() for i in ids}
        if step == 2:
            segments.remove(spark, path, spark.createDataFrame([("d0",), ("d7",), ("nothing",)], "document_id string"))
            now.pop(0), now.pop(7)
        want = plain(spark.createDataFrame([r for rs in now.values() for r in rs], part.schema))
        assert held(spark, path) == want
    assert segments.merge(spark, path) == 1 and held(spark, path) == want
    assert [r.level for r in segments.live(spark, path)] == [0, 1]
    segments.remove(spark, path, spark.createDataFrame([("d1",)], "document_id string"))
    assert held(spark, path) == [x for x in want if x[1] != "d1"]


def test_lookups_reach_the_scans(spark, tmp_path):
    path = str(tmp_path / "i")
    segments.add(spark, path, paragraphs(spark, random.Random(2), range(4)))
    plan = segments.positions(spark, path).where("lemma = 'kot'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lemma,kot)" in plan


def test_a_new_segment_is_written_as_its_rows_lie(spark, tmp_path):
    path, rows = str(tmp_path / "i"), paragraphs(spark, random.Random(2), range(30)).repartition(3)
    segments.add(spark, path, rows)
    own = spark.read.parquet(f"{path}/{segments.live(spark, path)[0].place}").withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    files = {}
    for r in own.orderBy("at").collect():
        files.setdefault(r.file, []).append(r.lemma)
    assert len(files) == 3 and all(x == sorted(x) for x in files.values())
    assert held(spark, path) == sorted((r.form, r.document_id, r.paragraph_id, r.pos) for r in lemma.occurrences(rows).collect())
