"""Hard negatives by one-dimensional distance keys.

Largest inner product becomes nearest neighbour by one more component: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and
q' = (q, 0) have the squared distance |q|^2 + M^2 - 2 q.x. Every x' belongs to its nearest pivot, and the index is stored sorted
by (pivot, distance to it), in blocks of BLOCK rows at most that know their least and largest distance. By the triangle
inequality a row within R of q' has a key between d(q', pivot) - R and d(q', pivot) + R. So a search scans those intervals of all
pivots, and widens R: all rows of a score of t or more are known once R reaches the distance that t stands for. The search of an
ask ends when its k-th score is above what has not been scanned, or nothing that it may take is left. Each round scans only the
annuli between the radius before and the present one.

Asks travel in chunks of CHUNK to the blocks that they need, so a task holds one block and one chunk; what a block gives is k rows
an ask. Pivots come from a sample of SAMPLE rows, which also tells each ask where to look first; neither changes results.

Scores are exact integers as long as they fit in 64 bits. Rows with a null id, label or vector, or with a null or non-finite
component take no part. Shorter vectors count as filled up with zeros. An id names one row: of several rows with one id only that
with the least label and vector takes part. Equal vectors tie, and ties go by the smaller id. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

#: Rows that the pivots are chosen from, pivots, rows of a block and asks of a chunk at most.
SAMPLE, PIVOTS, BLOCK, CHUNK = 4096, 32, 8192, 256
#: A score below all others, and one above.
LOWEST, HIGHEST = -(1 << 62), 1 << 62
TOP = "array<struct<score: long, vec_id: long>>"


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (longs: floor(scale * x)) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    one = own.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), v.alias("v"))).alias("r"))
    return one.select("vec_id", "r.label", "r.v")


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) longs of a column of lists, filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), dims), np.int64)
    values = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of longs: by floating point where no sum can leave its exact range."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class Space:
    """What an index knows of all rows: dimensions, the largest squared norm, pivots, and a sample of rows."""

    def __init__(self, dims: int, largest: float, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.dims, self.largest, self.ids, self.labels, self.v = dims, largest, ids, labels, v
        points = self.lifted(v)
        centres = points[: min(PIVOTS, len(points))].copy()
        for _ in range(5):  # a few steps towards the means of the cells
            near = self.distances(points, centres).argmin(1)
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = points[near == c].mean(0)
        self.pivots = centres

    def lifted(self, v: np.ndarray, ask: bool = False) -> np.ndarray:
        v = v.astype(np.float64)
        last = np.zeros(len(v)) if ask else np.sqrt(np.maximum(self.largest - (v * v).sum(1), 0.0))
        return np.concatenate([v, last[:, None]], 1)

    @staticmethod
    def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        square = (points * points).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * points @ centres.T
        return np.sqrt(np.maximum(square, 0.0))

    def radius(self, v: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The distance within which all rows of a score of t or more lie; infinite for the lowest score, -1 for none."""
        square = (v.astype(np.float64) ** 2).sum(1) + self.largest - 2 * t
        r = np.where(square < 0, -1.0, np.sqrt(np.maximum(square, 0.0)))
        return np.where(t <= LOWEST, np.inf, r)

    @property
    def slack(self) -> float:
        """More than rounding can take from a distance."""
        return 1e-6 * (1.0 + self.largest**0.5)


def space_of(rows: DataFrame) -> Space | None:
    """None for an empty table. The sample are the rows whose ids have the least hashes."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dims, largest = rows.agg(F.max(F.size("v")), F.max(norm)).first()
    if dims is None:
        return None
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    return Space(dims, largest * (1 + 1e-12), some["vec_id"].to_numpy(), some["label"].to_numpy(), matrix(some["v"].combine_chunks(), dims))


BLOCKS = "block long, pivot int, low double, high double, n int, data binary"


def index(rows: DataFrame, space: Space) -> DataFrame:
    """BLOCKS of the rows, stored in the order of (pivot, distance)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = space.distances(space.lifted(matrix(b.column(2), space.dims)), space.pivots)
            pivot = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(d)), pivot])], names=["vec_id", "label", "v", "pivot", "distance"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = TaskContext.get().partitionId() << 40, []

        def cut(rows: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal place
            table = pa.Table.from_batches(rows).combine_chunks()
            pivot = table["pivot"].to_numpy()
            start = 0
            while start < len(pivot):
                stop = min(start + BLOCK, int(np.searchsorted(pivot, pivot[start], "right")))
                if stop == len(pivot) and stop - start < BLOCK and not last:
                    break
                part = table.slice(start, stop - start)
                d = part["distance"].to_numpy()
                data = pickle.dumps((part["vec_id"].to_numpy(), part["label"].to_numpy(), matrix(part["v"].combine_chunks(), space.dims), d))
                yield pa.RecordBatch.from_pylist([{"block": place, "pivot": int(pivot[start]), "low": float(d[0]), "high": float(d[-1]), "n": stop - start, "data": data}], schema)
                place, start = place + 1, stop
            rows[:] = table.slice(start).to_batches() if start < len(pivot) else []

        schema = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("data", pa.binary())])
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 2 * BLOCK:
                yield from cut(held, False)
        if held:
            yield from cut(held, True)

    found = rows.select("vec_id", "label", "v").mapInArrow(keyed, "vec_id long, label long, v array<long>, pivot int, distance double")
    dealt = found.repartitionByRange(partitions(rows.sparkSession), "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    return stored(dealt.mapInArrow(blocks, BLOCKS), "annuli")


#: An ask: whose vector, the same label or others, the scores that count, how many; then how far it is scanned, and its best rows.
ASKS = ["ask", "anchor", "label", "v", "same", "cap", "least", "k", "scanned", "top"]


def aims(space: Space, table: pa.Table, first: bool) -> np.ndarray:
    """The score down to which each ask is scanned next: first to the best eligible row of the sample; then to the k-th score that
    is known from the scans or the sample; where neither has k, to the least score that counts."""
    q = matrix(table["v"].combine_chunks(), space.dims)
    scores = products(q, space.v)
    out = np.zeros(len(q))
    for i, (anchor, label, same, cap, least, k, top) in enumerate(zip(*(table[c].to_pylist() for c in ("anchor", "label", "same", "cap", "least", "k", "top")))):
        fit = ((space.labels == label) == same) & (space.ids != anchor) & (scores[i] <= cap) & (scores[i] >= least)
        best = np.sort(scores[i][fit])[::-1]
        wanted = 1 if first else k
        known = [best[wanted - 1]] if len(best) >= wanted else []
        known += [top[k - 1]["score"]] if len(top) >= k else []
        out[i] = max(known) - 0.5 if known else (least - 0.5 if least > LOWEST else LOWEST)
    return out


def scan(asks: DataFrame, blocks: DataFrame, space: Space, first: bool) -> DataFrame:
    """ask, scanned, found: for each ask the k best rows of the blocks' parts that are new within its next radius."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, schema = TaskContext.get().partitionId() << 40, pa.schema([("chunk", pa.int64()), ("data", pa.binary()), ("needs", pa.list_(pa.struct([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))), ("aims", pa.list_(pa.struct([("ask", pa.int64()), ("aim", pa.float64())])))])
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                t = pa.Table.from_batches([batch.slice(start, CHUNK)])
                q = matrix(t["v"].combine_chunks(), space.dims)
                aim = aims(space, t, first)
                d = space.distances(space.lifted(q, True), space.pivots)
                after = space.radius(q, aim) + space.slack
                before = np.where(np.isnan(t["scanned"].to_numpy()), -1.0, space.radius(q, np.nan_to_num(t["scanned"].to_numpy())) - space.slack)
                own = [t[c].to_numpy(zero_copy_only=False) for c in ("ask", "anchor", "label", "same", "cap", "least", "k")]
                needs = [{"pivot": p, "low": float((d[:, p] - after).min()), "high": float((d[:, p] + after).max())} for p in range(d.shape[1])]
                told = [{"ask": a, "aim": x} for a, x in zip(own[0].tolist(), aim.tolist())]
                yield pa.RecordBatch.from_pylist([{"chunk": number, "data": pickle.dumps((q, d, before, after, *own)), "needs": needs, "aims": told}], schema)
                number += 1

    packed = stored(asks.select(*ASKS).mapInArrow(chunks, "chunk long, data binary, needs array<struct<pivot: int, low: double, high: double>>, aims array<struct<ask: long, aim: double>>"), "asks")
    needs = packed.select("chunk", F.inline("needs")).select("chunk", F.col("pivot").alias("near"), F.col("low").alias("from_low"), F.col("high").alias("to_high"))
    there = blocks.select("block", "pivot", "low", "high")
    pairs = needs.join(there, (needs.near == there.pivot) & (there.low <= needs.to_high) & (there.high >= needs.from_low)).select("block", "chunk")
    sent = pairs.join(packed.select("chunk", "data"), "chunk").select("block", F.lit(1).alias("kind"), F.lit(0).alias("pivot"), "data")
    both = blocks.join(pairs.select("block").distinct(), "block", "left_semi").select("block", F.lit(0).alias("kind"), "pivot", "data").union(sent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ask", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])
        block = None
        for batch in batches:
            for kind, pivot, data in zip(*(batch.column(i) for i in (1, 2, 3))):
                if kind.as_py() == 0:
                    block = (pivot.as_py(), *pickle.loads(data.as_py()))
                else:
                    rows = best_rows(block, pickle.loads(data.as_py()))
                    if len(rows[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], schema=schema)

    dealt = both.repartition(partitions(asks.sparkSession), "block").sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(work, "ask long, score long, vec_id long")
    ranked = found.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("found"))
    return packed.select(F.inline("aims")).join(ranked, "ask", "left")


def best_rows(block: tuple, chunk: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ask, score, vec_id): the k best rows of the block for each ask of the chunk, among those in its annulus."""
    pivot, ids, labels, x, key = block
    q, d, before, after, ask, anchor, label, same, cap, least, k = chunk
    scores = products(q, x)
    off = np.abs(d[:, pivot, None] - key[None, :])
    fit = (off <= after[:, None]) & (off > before[:, None]) & (scores <= cap[:, None]) & (scores >= least[:, None])
    fit &= (labels[None, :] == label[:, None]) == same[:, None]
    fit &= ids[None, :] != anchor[:, None]
    out = [], [], []
    for i in np.flatnonzero(fit.any(1)):
        at = np.flatnonzero(fit[i])
        s = scores[i, at]
        if len(at) > k[i]:
            good = s >= np.partition(s, len(s) - k[i])[len(s) - k[i]]
            at, s = at[good], s[good]
        order = np.lexsort((ids[at], -s))[: k[i]]
        for held, values in zip(out, (np.full(len(order), ask[i]), s[order], ids[at[order]])):
            held.append(values)
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out)


def search(asks: DataFrame, blocks: DataFrame, space: Space, most_rounds: int = 8) -> DataFrame:
    """ask, anchor, cap, top: for each ask its k best rows. asks: ASKS without scanned and top."""
    state = stored(asks.withColumns({"scanned": F.lit(float("nan")), "top": F.lit(None).cast(TOP)}).withColumn("top", F.coalesce("top", F.array().cast(TOP))), "search")
    ended = []
    for number in range(most_rounds):
        told = scan(state, blocks, space, number == 0)
        merged = F.array_distinct(F.concat(F.transform("top", lambda x: F.struct((-x["score"]).alias("minus"), x["vec_id"].alias("vec_id"))), F.coalesce("found", F.array().cast("array<struct<minus: long, vec_id: long>>"))))
        top = F.transform(F.slice(F.sort_array(merged), 1, F.col("k")), lambda x: F.struct((-x["minus"]).alias("score"), x["vec_id"].alias("vec_id")))
        now = state.join(told, "ask").select("ask", "anchor", "label", "v", "same", "cap", "least", "k", F.col("aim").alias("scanned"), top.alias("top"))
        # What has not been scanned scores below `scanned`.
        sure = (F.col("scanned") < F.col("least")) | ((F.size("top") >= F.col("k")) & (F.element_at("top", -1)["score"] > F.col("scanned")))
        now = stored(now.withColumn("sure", sure | (F.col("scanned") <= LOWEST)), "search")
        ended.append(now.where("sure").select("ask", "anchor", "cap", "top"))
        state = now.where("not sure").drop("sure")
        if state.isEmpty():
            break
    else:
        raise RuntimeError(f"searches are open after {most_rounds} rounds")
    out = ended[0]
    for more in ended[1:]:
        out = out.union(more)
    return out


def hard_negatives(rows: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, least_percent: int = 80, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Positives: the k_positive best other rows of the anchor's label. Negatives of a positive: the best rows of other labels that
    score no more than it and at least least_percent of it (none where it is negative)."""
    spark = rows.sparkSession
    own = stored(whole_vectors(rows, scale), "vectors")
    space = space_of(own)
    if space is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = index(own, space)
    anchors = own.where(is_anchor)
    lit = lambda x, kind: F.lit(x).cast(kind)
    asked = anchors.select(F.col("vec_id").alias("ask"), F.col("vec_id").alias("anchor"), "label", "v", lit(True, "boolean").alias("same"), lit(HIGHEST, "long").alias("cap"), lit(LOWEST, "long").alias("least"), lit(k_positive, "int").alias("k"))
    positives = stored(search(asked, blocks, space).select("anchor", F.inline("top")).select("anchor", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")
    caps = positives.where("positive_score >= 0").select("anchor", F.col("positive_score").alias("cap")).distinct()
    least = F.expr(f"cast(({least_percent} * cast(cap as decimal(38, 0)) + 99) div 100 as long)")
    asked = caps.join(anchors.withColumnRenamed("vec_id", "anchor"), "anchor").select(F.monotonically_increasing_id().alias("ask"), "anchor", "label", "v", lit(False, "boolean").alias("same"), "cap", least.alias("least"), lit(k_negative, "int").alias("k"))
    found = search(stored(asked, "caps"), blocks, space).select("anchor", F.col("cap").alias("positive_score"), F.posexplode("top").alias("place", "t"))
    out = positives.join(found, ["anchor", "positive_score"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("negative_id"), "positive_score", F.col("t.score").alias("negative_score"))
