"""Near duplicates by 64-bit SimHash: all fingerprints within a Hamming radius are linked, found in BK-trees.

Fingerprints (4-word shingles, XXH64 with seed 42, a bit set where over half of the shingles have it) come from built-in
functions. Distinct fingerprints are cut into shards so that any two within the radius share a shard: with b blocks of bits,
two fingerprints within r bits agree in b - r blocks, and each choice of that many blocks and their bits is a shard. Every
shard is a BK-tree: a node's children are keyed by their integer distance to it, and a query at distance d follows only the
edges from d - r to d + r. Trees grow with the data, so they are not broadcast: each is built and searched in the task that
holds its shard. More blocks are taken as the corpus grows, and where a cluster makes a shard too large for one task.

Within a shard the links are merged by union-find, so a shard gives at most one link per fingerprint, and the rest is
connected components over those links (large-star and small-star steps, written to the checkpoint folder between steps).
No list of links, components or fingerprints goes to the driver.

near_duplicates() links by fingerprints alone, as the query's contract has it. drop_near_duplicates() is for corpora: texts
are near duplicates if their sets of word shingles have a Jaccard similarity of at least 0.8 (five words). There the shards
are shared shingles of the texts' prefixes, which misses no such pair, and BK-trees over SimHashes of 1024 bits link texts within a
radius that such pairs lie within (see REACH). Texts that are linked are a family; within it the sets decide.

Null texts count as empty; texts without words have the fingerprint 0 and are linked like any other. Repeated rows give
repeated results. A row whose id is null is linked too but names no component (a component of such rows only is null).
An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions, shared_dir, stored, text_of
from .votes import ascii_lower, block_keys, fingerprint, lane_sums, shingle_at, words_of

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

#: Fingerprints searched at once, and rows taken from a partition at once (whole shards).
QUERIES, ROWS = 2_000, 200_000
#: Fingerprints of a shard: their mean at most, and how many are dealt again by finer shards; blocks that the finest shards fix.
SHARD, MOST, FINEST = 256, 1024, 5
#: Edges of a file between the steps of components().
EDGES = 200_000


def fingerprints(docs: DataFrame, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, body (xxhash64 of the text), fp (long), n_rows (how often the row with this id and text occurs)."""
    text = text_of(text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), words_of(ascii_lower(text)).alias("words"))
    last = F.greatest(F.size("words") - shingle, F.lit(0))
    places = rows.select("doc_id", "body", "words", F.explode_outer(F.when(F.size("words") > 0, F.sequence(F.lit(0), last))).alias("i"))
    hashes = places.select("doc_id", "body", F.when(F.col("i").isNotNull(), F.xxhash64(shingle_at(F.col("words"), F.col("i"), shingle))).alias("h"), F.coalesce(F.col("i") == 0, F.lit(True)).alias("head"))
    sums = hashes.groupBy("doc_id", "body").agg(*lane_sums(F.col("h")), F.count("h").alias("total"), F.count_if("head").alias("n_rows"))
    return sums.select("doc_id", "body", fingerprint(F.col("total")).alias("fp"), "n_rows")


class Forest:
    """BK-trees of several shards at once, level by level. key: the shard of each fingerprint, in ascending order. fp: one
    row of 64-bit words for each fingerprint."""

    def __init__(self, key: np.ndarray, fp: np.ndarray):
        self.fp = fp = fp.reshape(len(key), -1)
        self.span = 64 * fp.shape[1] + 1
        n = len(fp)
        self.heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
        self.keys = key[self.heads]
        at = np.repeat(self.heads, np.diff(np.concatenate([self.heads, [n]])))
        waiting = np.flatnonzero(at != np.arange(n))
        codes, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(waiting):
            edge = at[waiting] * self.span + distance(fp[waiting], fp[at[waiting]])
            found, first, back = np.unique(edge, return_index=True, return_inverse=True)
            codes.append(found)
            children.append(waiting[first])
            down = waiting[first][back]
            at[waiting] = down
            waiting = waiting[down != waiting]
        self.codes, self.children = np.concatenate(codes), np.concatenate(children)
        order = np.argsort(self.codes, kind="stable")
        self.codes, self.children = self.codes[order], self.children[order]
        self.visited = 0

    def links(self, key: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) arrays: all nodes within the radius of each query (its shard, its fingerprint)."""
        fp = fp.reshape(len(key), -1)
        place = np.searchsorted(self.keys, key)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == key[known]
        queries = np.flatnonzero(known)
        nodes = self.heads[place[queries]]
        while len(queries):
            self.visited += len(queries)
            d = distance(fp[queries], self.fp[nodes])
            hit = d <= radius
            if hit.any():
                yield queries[hit], nodes[hit]
            low = np.searchsorted(self.codes, nodes * self.span + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.codes, nodes * self.span + np.minimum(d + radius, self.span - 1), "right")
            n = high - low
            ends = np.cumsum(n)
            place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(low, n)
            queries, nodes = np.repeat(queries, n), self.children[place]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over arrays: parent after these links; each entry points to the smallest index of its set."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def shard_links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, fingerprint) pairs that connect what links connect within each shard, one per fingerprint at most."""
    alone = np.ones(len(key), bool)
    same = key[1:] == key[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    key, fp = key[~alone], fp[~alone]
    forest, parent = Forest(key, fp), np.arange(len(fp))
    for start in range(0, len(fp), QUERIES):
        for a, b in forest.links(key[start : start + QUERIES], fp[start : start + QUERIES], radius):
            parent = merge(parent, a + start, b)
    tied = np.flatnonzero(parent != np.arange(len(fp)))
    return fp[tied], fp[parent[tied]]


def links(prints: DataFrame, radius: int = 4, n_distinct: int | None = None, agree: int = 1) -> DataFrame:
    """a, b (longs, a < b): links between distinct fingerprints (column fp) that connect all those within the radius.

    Shards fix `agree` of radius + agree blocks of bits, as few as keep the mean shard below SHARD. The fingerprints of shards
    that are larger than MOST all the same (a cluster of near copies) are dealt again by finer shards instead."""
    distinct = prints.select("fp").where("fp is not null").distinct()
    n_distinct = distinct.count() if n_distinct is None else n_distinct
    while agree < FINEST and n_distinct > SHARD << (64 * agree // (radius + agree)):
        agree += 1
    rows = distinct.select("fp", F.inline(block_keys(F.col("fp"), radius + agree, agree))).select(F.xxhash64("table", "bits").alias("shard"), "fp")
    finer = None
    if agree < FINEST and n_distinct > MOST:
        hot = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST).select("shard").checkpoint()
        if not hot.isEmpty():
            again = rows.join(hot, "shard", "left_semi").select("fp").distinct().checkpoint()
            finer = links(again, radius, None, agree + 1)
            rows = rows.join(hot, "shard", "left_anti")
    n = partitions(prints.sparkSession)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_shards(batches):
            a, b = (x.view(np.int64) for x in shard_links(columns[0], columns[1].view(np.uint64), radius))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    dealt = rows.repartition(n, "shard").sortWithinPartitions("shard", "fp")
    found = dealt.mapInArrow(work, "a long, b long").where("a <> b").distinct()
    return found if finer is None else found.union(finer)


def whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows that are sorted by the first one, about ROWS at once, no shard cut in two."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= ROWS:
            columns = [np.concatenate(x) for x in zip(*held)]
            end = int(np.searchsorted(columns[0], columns[0][-1], "left"))  # the last shard may go on
            if end:
                yield [c[:end] for c in columns]
            held, size = [[c[end:] for c in columns]], len(columns[0]) - end
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """node, root (longs): for every node of edges (a, b), the smallest node that it is connected to.

    Large-star: a node hangs its larger neighbours on its smallest neighbour. Small-star: it hangs its smaller neighbours and
    itself on the smallest. Both keep what is connected; alternating them ends in stars around the smallest nodes."""
    shared_dir(edges.sparkSession)
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct().checkpoint()  # u < v from here on
    files = min(partitions(edges.sparkSession), edges.count() // EDGES + 1)  # edges never become more
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    state = None
    for _ in range(most_steps):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v"), F.col("m")).where("v <> m").distinct()
        # Here v hangs on m < v.
        least = large.groupBy("v").agg(F.min("m").alias("root"))
        small = large.join(least, "v").select(F.col("m").alias("v"), F.col("root").alias("u")).where("u <> v").union(least.select("v", F.col("root").alias("u")))
        edges = small.select("u", "v").distinct().coalesce(files).checkpoint()
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components are not found after {most_steps} steps")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, body, fp, component_id: the smallest doc_id that is reachable over links, the own one included. One row per row."""
    shared_dir(docs.sparkSession)
    prints = fingerprints(docs, shingle, id_column, text_column).checkpoint()
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    roots = components(links(own, radius))
    tied = roots.select(F.col("node").alias("fp"), "root").join(own, "fp")
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = tied.join(least, "root").select("fp", "component_id")
    of_print = own.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # Stored first, so that a fingerprint of very many rows can be split in the join.
    out = prints.join(of_print.checkpoint(), "fp").select("doc_id", "body", "fp", "component_id", "n_rows")
    return out.select("doc_id", "body", "fp", "component_id", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")).alias("copy")).drop("copy")


# --- near duplicates by the texts' own similarity ---

#: Texts whose shingles are counted to put common ones last (this bounds work, not what is found), and most common shingles kept.
SAMPLE, COMMON = 5_000, 1 << 17
#: Most bits of a table of hashes that may occur (only what the joins after it would drop anyway is left out early).
MOST_BITS = 1 << 25
#: Words of 64 bits in a text's fingerprint, and the radius for a set of more hashes than FEW and of so many or fewer. Of two large
#: sets with a Jaccard similarity of 0.8 a bit differs with a probability of 0.16, of small ones (five hashes against four) 0.19, so
#: such a pair lies beyond the radius less than once in 10**9. Sets with a similarity of 0.5 lie within it once in 500.
WIDTH, REACH, REACH_FEW, FEW = 16, 240, 290, 50
PRINT = [f"f{i}" for i in range(WIDTH)]
#: Bytes of text whose shingles are made at once.
BATCH_BYTES = 1_500_000
#: Texts of a block of a posting, and hashes of a block of a family.
NODES, HASHES = 4096, 2_000_000
#: Nodes that are visited at once, and candidates of a set that are compared before all others.
VISITS, NEAREST = 60_000, 8


def shingle_set(text: str, k: int) -> frozenset[str]:
    """The distinct k-word shingles of a text as fingerprints() has them."""
    words = _WORD.findall(text.translate(_LOWER))
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def alike(a: frozenset[str], b: frozenset[str], least: float) -> bool:
    """Whether two sets' Jaccard similarity reaches `least`. Two empty sets are alike."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not large:
        return True
    if len(small) < least * len(large):
        return False
    both = len(small & large)
    return both >= least * (len(a) + len(b) - both)


def identity(text: Column) -> list[Column]:
    """body, twin: 128 bits that stand for a text."""
    return [F.xxhash64(text).alias("body"), F.xxhash64(F.lit("twin"), text).alias("twin")]


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the ascending hashes (unsigned) of its distinct k-word shingles; none for a text without words."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = parts.values.dictionary_encode()
    names = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    codes, offsets = coded.indices.to_numpy(), parts.offsets.to_numpy().astype(np.int64)
    full = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[codes]  # white space at the ends gives empty words
    word = names[codes[full]] if len(codes) else np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    sizes = np.diff(offsets)
    last = np.repeat(offsets[1:], sizes)
    h = np.zeros(len(word), np.uint64)
    for j in range(k):
        inside = np.arange(len(word)) + j < last
        step = (h ^ np.concatenate([word[j:], np.zeros(min(j, len(word)), np.uint64)])) * np.uint64(0x9E3779B97F4A7C15)
        h = np.where(inside, step ^ (step >> np.uint64(29)), h)
    stops = offsets[:-1] + np.where(sizes > 0, np.maximum(sizes - k + 1, 1), 0)
    return [ascending(h[a:b]) for a, b in zip(offsets[:-1].tolist(), stops.tolist())]


def ascending(h: np.ndarray) -> np.ndarray:
    """The distinct values, by sorting (np.unique hashes them first, which takes longer here)."""
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about BATCH_BYTES of a text column."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(ends // BATCH_BYTES)) + 1).tolist(), b.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield b.slice(start, stop - start)


def named_texts(docs: DataFrame, text_column: str) -> DataFrame:
    """body, twin, text. One row per row."""
    text = text_of(text_column)
    return docs.select(*identity(text), text.alias("text"))


def common_shingles(rows: DataFrame, n_texts: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count), by hash: shingles that several texts of a sample have."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(batch.column(0), shingle)).view(np.int64))], names=["h"])

    sample = rows.where(F.pmod("body", F.lit(max(1, n_texts // SAMPLE))) == 0).select("text").mapInArrow(lean(of), "h long")
    counts = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([r.h for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(sets: list[np.ndarray], least: float, common: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Of each set of n hashes the first n - ceil(least * n) + 1 in one order of all hashes, in which those of `common` come last
    by their counts: a passage that many share names few candidates.

    Sets whose Jaccard similarity reaches `least` share at least ceil(least * n) of either's n hashes, so the first shared one
    lies in both prefixes: no such pair is missed. A set of none has the prefix 0, so that such sets meet."""
    out = []
    for hs in sets:
        if not len(hs):
            out.append(np.zeros(1, np.uint64))
            continue
        length = len(hs) - int(np.ceil(least * len(hs) - 1e-9)) + 1
        if len(common[0]):
            place = np.minimum(np.searchsorted(common[0], hs), len(common[0]) - 1)
            count = np.where(common[0][place] == hs, common[1][place], 0)
            rare = hs[count == 0]
            if len(rare) < length:
                hs = np.concatenate([rare, hs[count > 0][np.argsort(count[count > 0], kind="stable")]])
            else:
                hs = rare
        out.append(hs[:length])
    return out


#: The lowest bit of each byte of a word.
LANES = np.uint64(0x0101010101010101)


def runs(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of the given sizes (none is 0), end to end, in runs of `most` at most: where each run starts, and the first
    run of each stretch."""
    n = -(-sizes // most)
    part = np.cumsum(n) - n
    inside = np.arange(int(n.sum())) - np.repeat(part, n)
    return np.repeat(np.cumsum(sizes) - sizes, n) + most * inside, part


def set_prints(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, WIDTH): the SimHash of each set of hashes, a bit being set where over half of the hashes have it. The further
    words' bits are those of the hashes scrambled again and again."""
    out = np.zeros((len(sets), WIDTH), np.uint64)
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sets):  # about 50,000 hashes at once, whole sets
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 50_000, "right")))
        full = start + np.flatnonzero(sizes[start:stop])
        if len(full):
            words = np.concatenate(sets[start:stop])
            heads, part = runs(sizes[full], 255)
            for j in range(WIDTH):
                # The eight bytes of a word count eight bits side by side: no byte overflows in a run of 255.
                lanes = [np.add.reduceat(words >> np.uint64(i) & LANES, heads).view(np.uint8).reshape(-1, 8) for i in range(8)]
                votes = np.add.reduceat(np.stack(lanes, 2).reshape(-1, 64), part, axis=0, dtype=np.int32)
                out[full, j] = np.packbits(votes * 2 > sizes[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
                words = (words ^ (words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                words ^= words >> np.uint64(32)
        start = stop
    return out


def lists(sets: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(values))


def marks(hashes: DataFrame) -> np.ndarray:
    """A table of booleans, true at the lower bits of each hash in the first column: 64 places a hash or more, up to MOST_BITS."""
    name = hashes.columns[0]
    size = 1 << min(MOST_BITS.bit_length() - 1, max(12, (64 * hashes.count()).bit_length()))
    at = F.col(name).bitwiseAND(F.lit(size - 1))
    words = hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table


def marked(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & (len(table) * 64 - 1)
    return (table[at >> 6] >> (at & 63)) & 1 == 1


def met_texts(rows: DataFrame, least: float, n_texts: int, shingle: int) -> DataFrame:
    """t (a number), body, twin, n, fingerprint, hs: each distinct text with its set's size and fingerprint, and those hashes of
    its prefix that (all but a few) another row has in its prefix too. Texts without such hashes are left out."""
    common = common_shingles(rows, n_texts, shingle)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes(shingle_sets(batch.column(0), shingle), least, common)).view(np.int64))], names=["h"])

    # The prefixes are made twice rather than kept: few of their hashes have company, and all of them take much disk.
    company = rows.select("text").mapInArrow(lean(alone), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    table = marks(stored(company, "company"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            sets = shingle_sets(batch.column(2), shingle)
            met = [h[marked(table, h.view(np.int64))] for h in prefixes(sets, least, common)]
            at = [i for i, h in enumerate(met) if len(h)]
            prints = set_prints([sets[i] for i in at]).view(np.int64)
            own = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            columns = [pa.array([len(sets[i]) for i in at], pa.int64()), *[pa.array(prints[:, j].copy()) for j in range(WIDTH)], lists([met[i] for i in at])]
            yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=["body", "twin", "n", *PRINT, "hs"])

    texts = rows.mapInArrow(lean(kept), f"body long, twin long, n long, {', '.join(f'{f} long' for f in PRINT)}, hs array<long>").dropDuplicates(["body", "twin"])
    return stored(texts.withColumn("t", F.monotonically_increasing_id()), "texts")


def reach(n: np.ndarray) -> np.ndarray:
    """The radius for a set of n hashes."""
    return np.where(n <= FEW, REACH_FEW, REACH)


def chunks_of(work: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches whose work adds up to about `most`."""
    ends, start = np.cumsum(work), 0
    while start < len(work):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop)
        start = stop


class Union:
    """Union-find over 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def tie(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def blocks_of(pieces: Column, number: Column) -> Column:
    """Array of (i, j, side), i <= j: the pairs of blocks that a member of the block `number` belongs to, and on which side. In
    (i, i) all members meet each other, in (i, j) those of one side the other's."""
    to = F.sequence(F.lit(0).cast("long"), pieces - 1)
    return F.transform(to, lambda j: F.struct(F.least(number, j).alias("i"), F.greatest(number, j).alias("j"), (number > j).cast("long").alias("side")))


def near_texts(texts: DataFrame) -> DataFrame:
    """a, b: links that connect all texts of a posting whose fingerprints are near, as many as texts at most from each shard.

    Shards are postings, or pairs of blocks of NODES texts of larger ones."""
    rows = texts.select("t", "n", *PRINT, F.explode("hs").alias("h"))
    large = rows.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > NODES).select("h", F.ceil(F.col("k") / NODES).cast("long").alias("pieces"))
    rows = rows.join(large, "h", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("long")))
    rows = rows.select("h", "t", "n", *PRINT, F.inline(blocks_of(F.col("pieces"), F.pmod(F.xxhash64("t"), F.col("pieces")))))
    rows = rows.select(F.xxhash64("h", "i", "j").alias("shard"), "side", "t", "n", *PRINT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_shards(batches):
            a, b = near_in_shards(*columns[:4], columns[4:])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = rows.repartition(partitions(texts.sparkSession), "shard").sortWithinPartitions("shard", "side")
    return dealt.mapInArrow(lean(work), "a long, b long").distinct()


def near_in_shards(shard: np.ndarray, side: np.ndarray, t: np.ndarray, n: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays a, b: links that connect near fingerprints within each shard, found in its BK-tree."""
    fp = np.stack(words, 1).view(np.uint64)
    order = np.lexsort((*words, side, shard))
    same = (shard[order][1:] == shard[order][:-1]) & (side[order][1:] == side[order][:-1]) & (fp[order][1:] == fp[order][:-1]).all(1)
    new = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
    heads = order[new]
    parent = np.arange(len(t))
    parent[order] = heads[np.cumsum(new) - 1]  # texts with one fingerprint hang on one of them
    nodes = heads[side[heads] == 0]
    forest = Forest(shard[nodes], fp[nodes])
    two = np.unique(shard[side == 1])
    asks = heads[(side[heads] == 1) | ~np.isin(shard[heads], two)]
    sizes = np.diff(np.append(forest.heads, len(nodes)))
    place = np.minimum(np.searchsorted(forest.keys, shard[asks]), max(len(sizes) - 1, 0))
    for radius in (REACH, REACH_FEW):
        mine = reach(n[asks]) == radius
        part, work = asks[mine], sizes[place[mine]] if len(sizes) else np.zeros(int(mine.sum()), np.int64)
        for piece in chunks_of(work, VISITS):
            some = part[piece]
            for q, node in forest.links(shard[some], fp[some], radius):
                q, node = some[q], nodes[node]
                apart = parent[q] != parent[node]
                if apart.any():
                    parent = merge_some(parent, q[apart], node[apart])
    tied = np.flatnonzero(t != t[parent])
    return t[tied], t[parent[tied]]


def merge_some(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """merge() of few links: only the roots that they name are united."""
    roots, at = np.unique(np.concatenate([parent[a], parent[b]]), return_inverse=True)
    low = merge(np.arange(len(roots)), at[: len(a)], at[len(a) :])
    to = np.arange(len(parent))
    to[roots] = roots[low]
    return to[parent]


MEMBER = "shard long, side long, t long, n long"


def members(texts: DataFrame, families: DataFrame) -> DataFrame:
    """body, twin, t, n, shards (shard, side): the texts of families (node, root), and the pairs of blocks they are compared in.
    A block has HASHES hashes or so."""
    rows = texts.select("t", "body", "twin", "n").join(families.select(F.col("node").alias("t"), "root"), "t")
    pieces = rows.groupBy("root").agg(F.ceil((F.sum("n") + F.count(F.lit(1))) / HASHES).cast("long").alias("pieces"))
    rows = rows.join(pieces, "root").withColumn("blocks", blocks_of(F.col("pieces"), F.pmod(F.xxhash64("t"), F.col("pieces"))))
    return rows.select("body", "twin", "t", "n", F.transform("blocks", lambda b: F.struct(F.xxhash64("root", b["i"], b["j"]).alias("shard"), b["side"].alias("side"))).alias("shards"))


def sets_of(rows: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """named (body, twin, t and others) with hs, all hashes of each text; one row each."""
    table = marks(named.select("body"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(marked(table, batch.column(0).to_numpy())))
            for part in pieces(iter([some]), 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(shingle_sets(part.column(2), shingle))], names=["body", "twin", "hs"])

    return rows.mapInArrow(lean(work), "body long, twin long, hs array<long>").join(named, ["body", "twin"]).dropDuplicates(["t"])


def alike_texts(sets: DataFrame, least: float) -> DataFrame:
    """a, b: links between texts whose sets are alike, which connect all such texts of a shard; sets: t, shards, hs."""
    rows = sets.select("t", "hs", F.inline("shards")).select("shard", "side", "t", "hs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_lists(batches):
            hs = table["hs"].combine_chunks()
            offsets, values = hs.offsets.to_numpy().astype(np.int64), hs.values.to_numpy().view(np.uint64)
            own = [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            links_ = alike_in_shards(table["shard"].to_numpy(), table["side"].to_numpy(), own, least)
            t = table["t"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(t[links_[:, 0]]), pa.array(t[links_[:, 1]])], names=["a", "b"])

    dealt = rows.repartition(partitions(sets.sparkSession), "shard").sortWithinPartitions("shard", "side")
    return dealt.mapInArrow(lean(work), "a long, b long")


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by their first column, about HASHES values of the last one at once, no shard cut in two."""
    held, size = None, 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        size += batch.column(batch.num_columns - 1).flatten().nbytes // 8
        if size >= HASHES:
            key = held.column(0).to_numpy()
            end = int(np.searchsorted(key, key[-1], "left"))  # the last shard may go on
            if end:
                yield held.slice(0, end).combine_chunks()
                held = pa.concat_tables([held.slice(end)]).combine_chunks()
                size = int(pc.sum(pc.list_value_length(held.column(held.num_columns - 1))).as_py() or 0)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def alike_in_shards(shard: np.ndarray, side: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """(links, 2): places of alike sets that connect all alike sets of each shard.

    A set's candidates are the nodes of the shard's BK-tree within the radius. Those that are connected to it already are left out,
    the nearest are compared first, and the others all at once: so a large group takes few comparisons, and a set that stays alone
    is compared with every candidate."""
    out: list[tuple[int, int]] = []
    prints = set_prints(sets)
    n = np.array([len(s) for s in sets], np.int64)
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)]):
        rows = np.arange(a, b)
        nodes, asks = rows[side[a:b] == 0], rows[side[a:b] == 1]
        if not len(asks):
            asks = nodes
        if len(nodes) == 0 or b - a < 2:
            continue
        union = Union(b - a)
        forest = Forest(np.zeros(len(nodes), np.int64), prints[nodes])
        for radius in (REACH, REACH_FEW):
            part = asks[reach(n[asks]) == radius]
            for piece in chunks_of(np.full(len(part), len(nodes)), VISITS):
                some = part[piece]
                met = [(some[q], nodes[node]) for q, node in forest.links(np.zeros(len(some), np.int64), prints[some], radius)]
                if not met:
                    continue
                q, node = (np.concatenate(x) for x in zip(*met))
                fit = (q != node) & (np.minimum(n[q], n[node]) >= least * np.maximum(n[q], n[node]) - 1e-9)
                q, node = q[fit], node[fit]
                order = np.lexsort((distance(prints[q], prints[node]), q))
                q, node = q[order], node[order]
                cuts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
                for c, d in zip(cuts.tolist(), [*cuts[1:].tolist(), len(q)]):
                    compare(int(q[c]), node[c:d].tolist(), sets, n, least, union, a, out)
    return np.array(out, np.int64).reshape(-1, 2)


def compare(q: int, candidates: list[int], sets: list[np.ndarray], n: np.ndarray, least: float, union: Union, base: int, out: list[tuple[int, int]]) -> None:
    """Ties q to the candidates (nearest first) that are alike and not connected to it yet."""
    done = 0
    while done < len(candidates):
        batch = [c for c in candidates[done : done + (NEAREST if done == 0 else len(candidates))] if union.find(c - base) != union.find(q - base)]
        done = done + NEAREST if done == 0 else len(candidates)
        if not batch:
            continue
        if not len(sets[q]):  # sets of none are alike
            alike_ = np.array([len(sets[c]) == 0 for c in batch])
        else:
            joined, size = np.concatenate([sets[c] for c in batch]), n[batch]
            at = np.minimum(np.searchsorted(sets[q], joined), len(sets[q]) - 1)
            ends = np.cumsum(size)
            both = np.diff(np.concatenate([[0], np.cumsum(sets[q][at] == joined)[np.maximum(ends - 1, 0)]])) if len(joined) else np.zeros(len(batch), np.int64)
            alike_ = both >= least * (n[q] + size - both) - 1e-9
        for c in np.array(batch)[alike_].tolist():
            if union.tie(c - base, q - base):
                out.append((q, c))


def similar_links(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a, b: links between texts; t, body, twin: those texts).

    The links connect all texts that chains of alike texts connect. Alike texts share a hash of both prefixes, which is complete
    (see prefixes), and their fingerprints are near. So texts of a posting with near fingerprints are linked first, which gives
    families; then each text travels once, with all its hashes, to its family's shard, where the sets decide. What either step
    gives are links that connect, never all pairs; postings and families that are too large for a task are compared in pairs of
    blocks of bounded size."""
    shared_dir(docs.sparkSession)
    rows = named_texts(docs, text_column)
    texts = met_texts(rows, similarity, docs.count(), shingle)
    families = components(stored(near_texts(texts), "near"))
    named = stored(members(texts, families), "members")
    return stored(alike_texts(sets_of(rows, named, shingle), similarity), "alike"), texts.select("t", "body", "twin")


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    known = {c.lower() for t in tables for c in t.columns}
    while name.lower() in known:
        name += "_"
    return name


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the rows whose text is connected, over texts that are alike, to one of a smaller doc_id. Of equal texts
    with equal ids all stay or go together. Rows without an id stay. Other columns keep their values, whatever their names."""
    links_, texts = similar_links(docs, shingle, similarity, text_column)
    body, twin = identity(text_of(text_column))
    doc_id = F.col(id_column).cast("long")
    own = docs.groupBy(body, twin).agg(F.min(doc_id).alias("least"), F.max(doc_id).alias("most"))
    tied = own.join(texts.join(components(links_).select(F.col("node").alias("t"), "root"), "t"), ["body", "twin"], "left")
    smallest = tied.where("root is not null").groupBy("root").agg(F.min("least").alias("stays"))
    linked = tied.join(smallest, "root", "left").select("body", "twin", "most", F.coalesce("stays", "least").alias("stays")).where("most > stays")
    names = [unused(c, docs) for c in ("gone_body", "gone_twin", "gone_above")]
    linked = stored(linked.select(*[F.col(c).alias(x) for c, x in zip(("body", "twin", "stays"), names)]), "gone")
    own_names = [unused(c, docs, linked) for c in ("own_body", "own_twin", "own_id")]
    rows = docs.withColumns(dict(zip(own_names, (body, twin, doc_id))))
    gone = (F.col(own_names[0]) == F.col(names[0])) & (F.col(own_names[1]) == F.col(names[1])) & (F.col(own_names[2]) > F.col(names[2]))
    return rows.join(linked, gone, "left_anti").drop(*own_names)
