"""Repeated passages by De Bruijn compaction: a window of k words that occurs twice makes its words repeated.

The graph's edges are the windows of k words, its nodes the k - 1 words that neighbouring windows share. Edges and nodes are dealt
by anchors: a node's anchor is the least hash of its short runs of words, so all places of a node meet in one bucket, with the
edges before and behind it. A bucket therefore counts its edges right, knows which ones repeat, and which of its nodes do not
branch: an edge goes on to the next where it has no other follower that repeats and that one no other predecessor. Such edges
are compacted to local paths within the bucket. Paths of neighbouring buckets share an edge; joins on it, with pointers that
double their length each round, compact local paths to whole ones (unitigs). Every text is then a list of spans on paths.

Every edge has a source: the first of its places by (id, text, word). A span's words have to equal those at its source, which is
checked by digests of both; should hashes ever collide, everything is done again with other hashes.

A bucket of more than HOT runs is passed on whole and counted by Spark, edge by edge; there each edge is a path of its own. No task
holds such a bucket. Circular paths are taken edge by edge, too.

Null texts have no words. Texts of less than k words are never changed. Repeated rows are copies of each other, so all their
windows repeat. A null id is like the smallest one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bktree import pieces
from .common import partitions, stored, text_of

#: Words of an anchor, runs of a bucket that is handled in one task, edges that are handled at once.
ANCHOR, HOT, EDGES = 8, 30_000, 1_500_000
SEEDS = ("docket-spark-one", "docket-spark-two")
FIRST = -(1 << 63)
#: Odd factor of the rolling hash.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

RUNS = "anchor long, id long, body long, start int, edges binary"
FOUND = "kind int, id long, body long, start int, n int, head long, off int, source_id long, source_body long, source_start int, last long, anchor long, edges array<long>"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(texts: pa.Array, seed: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets of the texts in them)."""
    parts = pc.ascii_split_whitespace(texts)
    coded = parts.flatten().dictionary_encode()
    names = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), hash_key=seed, categorize=False)
    codes = coded.indices.to_numpy()
    offsets = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    if not len(codes):
        return np.zeros(0, np.uint64), offsets
    full = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[codes]  # white space at the ends gives empty words
    return names[codes[full]], np.concatenate([[0], np.cumsum(full)])[offsets]


class Rolling:
    """Hashes of all stretches of some words."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, FACTOR)]))
        self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, INVERSE)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:n], dtype=np.uint64)])

    def of(self, size: int) -> np.ndarray:
        """The hash of the `size` words from each place on, as far as there are so many."""
        n = max(0, len(self.sums) - size)
        return mixed((self.sums[size : size + n] - self.sums[:n]) * self.down[:n])


def least_of(h: np.ndarray, size: int) -> np.ndarray:
    """The least of `size` neighbours, from each place on."""
    span, out = 1, h
    while span * 2 <= size:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = size - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(words: np.ndarray, offsets: np.ndarray, k: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first edge in its text, first and last edge among all): maximal runs of nodes with one anchor in each text."""
    rolling = Rolling(words)
    least = least_of(rolling.of(anchor), k - anchor)  # of the k - 1 words from each place on
    sizes = np.diff(offsets)
    long_ = np.flatnonzero(sizes >= k)
    nodes = sizes[long_] - (k - 1) + 1
    text = np.repeat(long_, nodes)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(nodes) - nodes, nodes)
    at = offsets[text] + inside
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(at)) - 1
    first = np.maximum(inside[start] - 1, 0)
    last = np.minimum(inside[stop], sizes[text[start]] - k)
    return text[start], value[start], first, offsets[text[start]] + first, offsets[text[start]] + last, rolling.of(k)


def runs(docs: DataFrame, k: int, seed: str) -> DataFrame:
    """RUNS: for each run of nodes with one anchor, the edges around its nodes."""
    anchor = min(ANCHOR, k - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            words, offsets = hashed_words(batch.column(2), seed)
            if not len(words) or (np.diff(offsets) < k).all():
                continue
            text, value, first, a, b, edges = runs_of(words, offsets, k, anchor)
            n = b - a + 1
            ends = np.cumsum(n)
            flat = edges[np.arange(int(ends[-1])) - np.repeat(ends - n, n) + np.repeat(a, n)]
            data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.concatenate([[0], ends]) * 8).astype(np.int32)), pa.py_buffer(flat.tobytes())])
            own = batch.select([0, 1]).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), *own.columns, pa.array(first.astype(np.int32)), data], names=["anchor", "id", "body", "start", "edges"])

    return docs.mapInArrow(work, RUNS)


def local_paths(anchor: np.ndarray, start: np.ndarray, n: np.ndarray, edges: np.ndarray) -> tuple[dict, dict] | None:
    """Whole buckets of runs in the order of their texts. (spans, paths) as arrays by name, or None if no edge repeats.

    spans: run, start, n, head (hash of the path's first edge), off, source_run, source_start. paths: head, last, n."""
    run = np.repeat(np.arange(len(n)), n)
    place = start[run] + np.arange(len(edges)) - np.repeat(np.cumsum(n) - n, n)
    _, first, which, count = np.unique(edges ^ mixed(anchor.view(np.uint64))[run], return_index=True, return_inverse=True, return_counts=True)
    repeats = count[which] > 1
    if not repeats.any():
        return None
    size = len(count)
    both = repeats[1:] & repeats[:-1] & (run[1:] == run[:-1])
    a, b = np.divmod(np.unique(which[:-1][both] * size + which[1:][both]), size)
    straight = (np.bincount(a, minlength=size)[a] == 1) & (np.bincount(b, minlength=size)[b] == 1)
    before = np.full(size, -1)
    before[b[straight]] = a[straight]
    head, off = np.where(before >= 0, before, np.arange(size)), (before >= 0).astype(np.int64)
    for _ in range(size.bit_length() + 1):
        up = head[head]
        if (up == head).all():
            break
        head, off = up, off + off[head]
    circle = before[head] >= 0
    head, off = np.where(circle, np.arange(size), head), np.where(circle, 0, off)

    h, o, s = head[which], off[which], first[which]
    same = both & (h[1:] == h[:-1]) & (o[1:] == o[:-1] + 1) & (run[s[1:]] == run[s[:-1]]) & (place[s[1:]] == place[s[:-1]] + 1)
    at = np.flatnonzero(repeats & ~np.concatenate([[False], same]))
    end = np.flatnonzero(repeats & ~np.concatenate([same, [False]]))
    spans = {"run": run[at], "start": place[at], "n": end - at + 1, "head": edges[first[h[at]]], "off": o[at], "source_run": run[s[at]], "source_start": place[s[at]]}
    known = np.flatnonzero(count > 1)
    order = known[np.lexsort((off[known], head[known]))]
    tail = order[np.append(head[order][1:] != head[order][:-1], True)]
    paths = {"head": edges[first[head[tail]]], "last": edges[first[tail]], "n": off[tail] + 1}
    return spans, paths


def bucket_paths(found: DataFrame) -> DataFrame:
    """FOUND of RUNS: spans (kind 0), local paths (kind 1), and the runs of hot buckets as they are (kind 2)."""
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("body", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("head", pa.int64()), ("off", pa.int32()), ("source_id", pa.int64()), ("source_body", pa.int64()), ("source_start", pa.int32()), ("last", pa.int64()), ("anchor", pa.int64()), ("edges", pa.list_(pa.int64()))])

    def rows(kind: int, size: int, **columns) -> pa.RecordBatch:
        columns["kind"] = np.full(size, kind)
        cast = lambda v, t: v.cast(t) if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v.view(np.int64) if v.dtype == np.uint64 else v).cast(t)
        return pa.RecordBatch.from_arrays([cast(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def edges_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        column = table["edges"].combine_chunks()
        size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        return size, np.frombuffer(b"".join(column.to_pylist()), np.uint64)

    def hot(table: pa.Table) -> pa.RecordBatch:
        size, edges = edges_of(table)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(edges.view(np.int64)))
        return rows(2, table.num_rows, edges=lists, **{c: table[c].combine_chunks() for c in ("id", "body", "start", "anchor")})

    def cold(table: pa.Table) -> Iterator[pa.RecordBatch]:
        size, edges = edges_of(table)
        columns = {c: table[c].to_numpy() for c in ("anchor", "id", "body", "start")}
        if (out := local_paths(columns["anchor"], columns["start"].astype(np.int64), size, edges)) is None:
            return
        spans, paths = out
        run, source = spans.pop("run"), spans.pop("source_run")
        yield rows(0, len(run), id=columns["id"][run], body=columns["body"][run], source_id=columns["id"][source], source_body=columns["body"][source], **spans)
        yield rows(1, len(paths["n"]), **paths)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, passing = None, 0, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if passing is not None:  # the rest of a hot bucket
                n = int(np.searchsorted(t["anchor"].to_numpy(), passing, "right"))
                if n:
                    yield hot(t.slice(0, n))
                if n == t.num_rows:
                    continue
                t, passing = t.slice(n), None
            held = t if held is None else pa.concat_tables([held, t])
            size = held.num_rows
            anchors = held["anchor"].to_numpy()
            last = int(np.searchsorted(anchors, anchors[-1], "left"))
            if last and (last > HOT or held["edges"].nbytes > 8 * EDGES):
                yield from cold(held.slice(0, last))
                held, anchors = held.slice(last), anchors[last:]
                last = 0
            if last == 0 and held.num_rows > HOT:
                yield hot(held)
                held, passing = None, anchors[-1]
        if held is not None and held.num_rows:
            yield from cold(held)

    order = ["anchor", "id", "body", "start"]
    dealt = found.repartition(partitions(found.sparkSession), "anchor").sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(work, FOUND), "paths")


def hot_paths(found: DataFrame) -> DataFrame:
    """The spans and paths of hot buckets' runs (FOUND of kind 2), one for each repeated edge."""
    places = found.where("kind = 2").select("anchor", "id", "body", F.posexplode("edges").alias("i", "edge"), "start").withColumn("start", (F.col("start") + F.col("i")).cast("int"))
    counts = places.groupBy("anchor", "edge").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "body", "start")).alias("source")).where("times > 1")
    known = places.join(counts, ["anchor", "edge"])
    one, none = F.lit(1).cast("int"), F.lit(0).cast("int")
    return known.select("id", "body", "start", one.alias("n"), F.col("edge").alias("head"), none.alias("off"), F.col("source.id").alias("source_id"), F.col("source.body").alias("source_body"), F.col("source.start").alias("source_start"), F.col("edge").alias("last"))


def compacted(paths: DataFrame) -> DataFrame:
    """head, path, shift: for each local path (head, last, n) the whole path it is part of, and where on it its first edge is.

    A path whose last edge is another's first goes on there. Each round a path's pointer goes to where its pointer's pointer
    goes, by a join, until all are at paths that nothing comes before; what never gets there is circular and stays as it is."""
    one = stored(paths.groupBy("head").agg(F.max(F.struct("n", "last")).alias("p")).select("head", "p.last", "p.n"), "local")
    before = one.where("last <> head").select(F.col("last").alias("head"), F.col("head").alias("up"), (F.col("n") - 1).cast("long").alias("shift")).groupBy("head").agg(F.min(F.struct("up", "shift")).alias("b"))
    state = one.select("head").join(before, "head", "left").select("head", F.coalesce("b.up", "head").alias("up"), F.coalesce("b.shift", F.lit(0)).cast("long").alias("shift"), F.col("b").isNull().alias("top"))
    roots = stored(state.where("top").select("head"), "roots")
    state = stored(state.drop("top").join(roots.select(F.col("head").alias("up"), F.lit(True).alias("ended")), "up", "left").select("head", "up", "shift", F.coalesce("ended", F.lit(False)).alias("ended")), "pointers")
    rounds = one.count().bit_length() + 1
    for _ in range(rounds):
        open_ = state.where("not ended")
        if open_.isEmpty():
            break
        there = state.select(F.col("head").alias("up"), F.col("up").alias("next"), F.col("shift").alias("more"), F.col("ended").alias("end"))
        moved = open_.join(there, "up").select("head", F.col("next").alias("up"), (F.col("shift") + F.col("more")).alias("shift"), F.col("end").alias("ended"))
        state = stored(state.where("ended").union(moved), "pointers")
    circle = ~F.col("ended")
    return state.select("head", F.when(circle, F.col("head")).otherwise(F.col("up")).alias("path"), F.when(circle, 0).otherwise(F.col("shift")).alias("shift"))


def spans(docs: DataFrame, k: int, seed: str) -> DataFrame:
    """id, body, start, n, path, at, source_id, source_body, source_start: the stretches of n repeated edges of each text, where
    they lie on which path, and where their source is."""
    found = bucket_paths(runs(docs, k, seed))
    columns = ["id", "body", "start", "n", "head", "off", "source_id", "source_body", "source_start"]
    hot = stored(hot_paths(found), "hot")
    paths = found.where("kind = 1").select("head", "last", "n").union(hot.select("head", "last", "n").distinct())
    local = found.where("kind = 0").select(*columns).union(hot.select(*columns))
    local = local.join(compacted(paths), "head")
    # Along one path and one source, a text's places, the path's and the source's differ by constants. A source may leave the
    # path by edges that do not repeat and come back to it, so only pieces that touch are one span.
    place = local.select("id", "body", "start", (F.col("start") + F.col("n")).alias("stop"), "path", (F.col("shift") + F.col("off") - F.col("start")).alias("gap"), "source_id", "source_body", (F.col("source_start") - F.col("start")).alias("source_gap"))
    line = ["id", "body", "path", "gap", "source_id", "source_body", "source_gap"]
    order = Window.partitionBy(*line).orderBy("start", "stop")
    apart = F.col("start") > F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    place = place.distinct().withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = place.groupBy(*line, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    out = whole.select("id", "body", "start", (F.col("stop") - F.col("start")).cast("int").alias("n"), "path", (F.col("gap") + F.col("start")).alias("at"), "source_id", "source_body", (F.col("source_gap") + F.col("start")).cast("int").alias("source_start"))
    return stored(out, "spans")


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id (least long for null), body (hash of the text), text. One row per row."""
    text = text_of(text_column)
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(FIRST)).alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))


def kept_texts(docs: DataFrame, spans_: DataFrame, k: int, keep: bool) -> DataFrame:
    """id, body, doc_id, n_words, n_removed, kept (the text that is left, with keep), kept_sha256, digests (start, n, digest of words)."""
    asked = spans_.select("id", "body", "start", "n", F.lit(True).alias("own")).union(spans_.where("id <> source_id or body <> source_body or start <> source_start").select("source_id", "source_body", "source_start", "n", F.lit(False)))
    asked = asked.groupBy("id", "body", "start", "n").agg(F.max("own").alias("own"))
    asked = asked.groupBy("id", "body").agg(F.collect_list(F.struct("start", "n", "own")).alias("asked"))
    schema = pa.schema([("id", pa.int64()), ("body", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()), ("digests", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            out = []
            for id_, body, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().split()
                left, digests = words, []
                if wanted:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for w in wanted:
                        stop = w["start"] + w["n"] + k - 1
                        if w["own"]:
                            gone[w["start"]] += 1
                            gone[stop] -= 1
                        digests.append({"start": w["start"], "n": w["n"], "digest": hashlib.blake2b(b" ".join(words[w["start"] : stop]), digest_size=16).digest()})
                    left = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
                body_left = b" ".join(left)
                out.append({"id": id_, "body": body, "n_words": len(words), "n_removed": len(words) - len(left), "kept": body_left.decode() if keep else None, "kept_sha256": hashlib.sha256(body_left).hexdigest(), "digests": digests})
            yield pa.RecordBatch.from_pylist(out, schema)

    joined = docs.join(asked, ["id", "body"], "left").select("id", "body", "text", "asked")
    return stored(joined.mapInArrow(work, "id long, body long, n_words long, n_removed long, kept string, kept_sha256 string, digests array<struct<start: int, n: int, digest: binary>>"), "kept")


def unequal(spans_: DataFrame, done: DataFrame) -> bool:
    """Whether some span's words are not those at its source."""
    known = done.select("id", "body", F.inline("digests")).distinct()
    own = spans_.where("id <> source_id or body <> source_body or start <> source_start").join(known, ["id", "body", "start", "n"])
    own = own.groupBy("source_id", "source_body", "source_start", "n").agg(F.min(F.hex("digest")).alias("low"), F.max(F.hex("digest")).alias("high"))
    there = known.select(F.col("id").alias("source_id"), F.col("body").alias("source_body"), F.col("start").alias("source_start"), "n", F.hex("digest").alias("source"))
    met = own.join(there, ["source_id", "source_body", "source_start", "n"], "left")
    return not met.where("low <> high or source is null or low <> source").isEmpty()


def remove_repeats(docs: DataFrame, k: int = 35, id_column: str = "doc_id", text_column: str = "text", keep: bool = True, seeds: tuple[str, ...] = SEEDS) -> tuple[DataFrame, DataFrame]:
    """(texts, spans). texts: doc_id, n_words, n_removed, kept (words that are left, joined by spaces; null without keep),
    kept_sha256; one row per row. spans: as spans() has them, with ids of null as the least long."""
    if k < 2:
        raise ValueError("a window has two words or more")
    own = keyed(docs, id_column, text_column)
    for seed in seeds:
        places = spans(own, k, seed)
        done = kept_texts(own, places, k, keep)
        if not unequal(places, done):
            doc_id = F.when(F.col("id") != FIRST, F.col("id")).alias("doc_id")
            return done.select(doc_id, "n_words", "n_removed", "kept", "kept_sha256"), places
    raise RuntimeError("every hash gave different windows the same value")
