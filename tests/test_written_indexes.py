"""The trigram index against scans, and the digest tree against plain hashing."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docketspark.operators import search, trigram
from docketspark.operators.query import Filters, parse
from docketspark.sources import merkle

QUERIES = ["heed", '"of the"', "(zebra OR quagga) stripes", "zebra NOT stripes", "NOT zebra", "ab", "ze OR quagga", "zebra rok:2001", 'zebra "no such words"', "art. 5", "żółw"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(2)
    common = ["of", "the", "heed", "stripes", "word", "ab", "ń"]
    rows = []
    for i in range(6000):
        words = [rng.choice(common) for _ in range(rng.randint(0, 8))]
        if i % 997 == 5:
            words.append(rng.choice(["zebra", "quagga", "żółw", "art. 5"]))
        rows.append((i // 7, i % 7, f"p{i}", " ".join(words), ["inne", "tenor"][i % 2], 2000 + i % 3))
    df = spark.createDataFrame(rows, "doc_id long, pos int, paragraph_id string, text string, section_key string, year int")
    df = df.withColumns({"text_legal": search.legal("text"), "case_signature_norm": F.lit("k"), "judge_norm": F.array(F.lit("x")), "decision_type_norm": F.lit("y"), "topic_norm": F.lit("z")})
    path = str(tmp_path_factory.mktemp("trigrams") / "i")
    trigram.write(df, path, ["doc_id", "pos"])
    return df.cache(), path


def scanned(df):
    """Rows that the scans of a collected plan gave."""
    total, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("Scan") or "ColumnarToRow" not in node.nodeName() and node.children().isEmpty():
            if node.metrics().contains("numOutputRows"):
                total += node.metrics().apply("numOutputRows").value()
        for i in range(node.children().size()):
            stack.append(node.children().apply(i))
    return total


@pytest.mark.parametrize("source", QUERIES)
def test_index_equals_scan(spark, index, source):
    df, path = index
    query, filters = parse(source), Filters(year_from=2000, year_to=2001)
    got = sorted((r.paragraph_id, r.score) for r in trigram.search(spark, path, query, filters).collect())
    assert got == sorted((r.paragraph_id, r.score) for r in search.hits(df, query, filters).collect())


def test_rare_texts_read_few_rows(spark, index):
    _, path = index
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for source in ("zebra OR quagga", "zebra NOT stripes", '"no such words"'):
            found = trigram.read(spark, path, parse(source))
            found.collect()
            assert scanned(found) < 600
        assert trigram.candidates(spark, path, parse("NOT zebra")) is None and trigram.candidates(spark, path, parse("ab")) is None
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_many_ranges_are_joined(spark):
    blocks = spark.range(0, 40_000, 3).withColumnRenamed("id", "block")
    for most in (1, 7, 200):
        kept = trigram.ranges(blocks, most)
        assert len(kept) <= most and all(any(a <= b <= z for a, z in kept) for b in range(0, 40_000, 333))
    assert trigram.ranges(blocks.where("block < 7")) == [(0, 0), (3, 3), (6, 6)] and trigram.ranges(blocks.limit(0)) == []


def plain_tree(rows):
    """rows: (key, digest)."""
    level = {}
    for key, digest in sorted(rows):
        level.setdefault(key // 256, []).append(digest)
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    nodes = {k: sha(v) for k, v in level.items()}
    while len(nodes) > 256:
        up = {}
        for k in sorted(nodes):
            up.setdefault(k // 256, []).append(nodes[k])
        nodes = {k: sha(v) for k, v in up.items()}
    return sha([nodes[k] for k in sorted(nodes)])


@pytest.mark.parametrize("keys", [[], [5], range(300), [-1, 0, 1], [0, 70_000, 10**9], [3, 3, 3, 900], range(0, 600 * 256, 128)])
def test_tree_hash(spark, keys):
    rows = [(k, f"x{i}") for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "key long, x string")
    digests = [(r.key, r.d) for r in df.select("key", merkle.row_digest(df).alias("d")).collect()]
    assert merkle.tree_hash(df, "key") == plain_tree(digests)


def test_only_changed_ranges_are_hashed_anew(spark):
    old = spark.range(2000).select(F.col("id").alias("key"), F.concat(F.lit("v"), "id").alias("x"))
    new = old.where("key <> 700").withColumn("x", F.when(F.col("key") == 3, "other").otherwise(F.col("x"))).union(spark.createDataFrame([(5000, "added")], "key long, x string"))
    before = merkle.leaves(old, "key")
    after = merkle.updated(before, new, "key", spark.createDataFrame([(3,), (700,), (5000,)], "key long"))
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, merkle.leaves(new, "key").collect()))
    assert merkle.root(after) == merkle.tree_hash(new, "key") != merkle.root(before)
