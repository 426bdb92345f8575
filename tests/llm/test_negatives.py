"""Hard negatives against SQL and against comparing all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketspark.llm import negatives, registry
from tests.oracle import duck, spark_rows

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, anchors, k=5):
    """By comparing all pairs. rows: (vec_id, label, vector)."""
    own = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            own[i] = min(own.get(i, (label, [])) if i in own else (label, [int(np.floor(256 * x)) for x in v]), (label, [int(np.floor(256 * x)) for x in v]))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (label, v) in own.items():
        if a not in anchors:
            continue
        scored = sorted((-dot(v, w), i, other == label) for i, (other, w) in own.items() if i != a)
        for ps, p, _ in [x for x in scored if x[2]][:k]:
            ps = -ps
            fit = [(-s, i) for s, i, same in scored if not same and 80 * ps <= -100 * s <= 100 * ps][:k]
            out += [(a, p, rank, i, ps, s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf):
    assert spark_rows(registry.op11_annulus_negatives(spark, sf)) == duck(registry.ORACLES["op11_annulus_negatives"], sf)


def test_odd_rows_small_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SAMPLE", 40)
    monkeypatch.setattr(negatives, "PIVOTS", 5)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "CHUNK", 3)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(size=6) + 0.6]) for i in range(300)]
    rows += [(1000 + i, i % 2, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(200)]  # one vector, very often
    rows += [(7, 2, rows[7][2]), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]  # repeated ids
    rows += [(None, 1, [1.0] * 6), (2000, None, [1.0] * 6), (2100, 1, None), (2200, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2300, 1, [float("nan")] * 6), (2400, 1, [float("inf")] * 6)]
    rows += [(3000, 9, [1.0] * 6), (3100, 8, [-1.0] * 6), (3200, 8, [1.0] * 6), (3300, 1, []), (3400, 1, [2.0])]  # alone, negative scores, short vectors
    df = spark.createDataFrame([(*r, 0, 1.0) for r in rows], "vec_id long, label int, embedding array<float>, pivot int, distance double")
    anchors = {r[0] for r in rows if r[0] is not None and r[0] % 10 == 0}
    want = plain([(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows], anchors)
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)) == want and want


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(empty, F.lit(True)).collect() == []
    one = spark.createDataFrame([(0, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(one, F.lit(True)).collect() == []


def test_large_values_are_exact():
    rng = random.Random(2)
    q = np.array([[rng.randint(-(1 << 29), 1 << 29) for _ in range(8)] for _ in range(3)])
    x = np.array([[rng.randint(-(1 << 29), 1 << 29) for _ in range(8)] for _ in range(4)])
    assert negatives.products(q, x).tolist() == [[sum(int(a) * int(b) for a, b in zip(r, s)) for s in x] for r in q]


def test_first_scans_leave_blocks_out(spark):
    """Clustered rows: the blocks that a first scan reads are a part of all."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 4
    rows = [(i, i % 3, [float(x) for x in centres[i % 20] + rng.normal(size=8) * 0.05]) for i in range(2000)]
    own = negatives.whole_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).cache()
    space = negatives.space_of(own)
    points = space.lifted(np.array([r.v for r in own.collect()]))
    asks = space.lifted(np.array([r.v for r in own.where("vec_id < 40").collect()]), True)
    key, home = space.distances(points, space.pivots).min(1), space.distances(points, space.pivots).argmin(1)
    d = space.distances(asks, space.pivots)
    best = np.sort(space.distances(asks, points), 1)[:, 5] + space.slack
    within = np.abs(d[:, home] - key[None, :]) <= best[:, None]
    near = space.distances(asks, points) <= best[:, None]
    assert (within | ~near).all() and within.mean() < 0.5
