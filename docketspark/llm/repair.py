"""Token ids in shard files compressed with a Re-Pair grammar, with random access to documents.

The file format is a Parquet table; each row is a shard of consecutive documents in ascending doc_id order:

    bucket int, shard int          place in the order: range of doc_id, then number within the range
    start long                     ids in the range before this shard
    n_docs int, n_tokens long
    doc_ids binary                 int64 each (ids that are null come first)
    doc_nulls binary               one byte each: 1 if the id is null
    doc_tokens binary              uint32 each
    first int, width int           first nonterminal; bytes of a symbol (2 or 4)
    rules binary                   two symbols for each nonterminal
    lengths binary                 uint32: how many ids each nonterminal expands to
    symbols binary                 the shard's text

Compression follows Re-Pair: the most frequent pairs of adjacent symbols are replaced by new nonterminals, again and again.
Each round counts all pairs and takes every pair that is frequent enough at once, the most frequent first where two overlap,
until none is. A document's ids are found by summing the symbols' expansion lengths up to its start and expanding only the
symbols that it touches.

Null texts count as empty; each document has the end id. Rows with equal ids are kept, ordered by text. An empty table gives
files without rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, partitions, range_bounds, text_of
from .vocab import encoder, vocabulary

LEAST = 8  # occurrences that make a rule worth its place
SHARD = 1 << 20  # ids after which a shard is closed
BATCH_CHARS = 8_000_000  # bytes of text that are encoded at once
TABLE_BITS = 20

FIELDS = [("bucket", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("doc_nulls", pa.binary()), ("doc_tokens", pa.binary()), ("first", pa.int32()), ("width", pa.int32()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary())]
DDL = "bucket int, shard int, start long, n_docs int, n_tokens long, doc_ids binary, doc_nulls binary, doc_tokens binary, first int, width int, rules binary, lengths binary, symbols binary"


@dataclass
class Grammar:
    first: int
    rules: np.ndarray  # (n, 2)
    lengths: np.ndarray  # ids that each rule expands to
    symbols: np.ndarray

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids below these symbols; one step for each level of the grammar."""
        out = symbols
        while len(self.rules):
            at = out >= self.first
            if not at.any():
                break
            size = at + np.int64(1)
            ends = np.cumsum(size)
            wider = np.empty(int(ends[-1]), np.uint32)
            wider[ends - 1] = out
            pair = self.rules[out[at] - self.first]
            wider[ends[at] - 2], wider[ends[at] - 1] = pair[:, 0], pair[:, 1]
            out = wider
        return out.astype(np.uint32)

    def sizes(self) -> np.ndarray:
        out = np.ones(len(self.symbols), np.int64)
        at = self.symbols >= self.first
        out[at] = self.lengths[self.symbols[at] - self.first]
        return out

    def slice(self, start: int, stop: int, ends: np.ndarray | None = None) -> np.ndarray:
        """The ids from start to stop, expanding only what they touch."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        ends = np.cumsum(self.sizes()) if ends is None else ends
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[start - before : stop - before]


def compress(ids: np.ndarray, first: int, least: int = LEAST) -> Grammar:
    """first: an id above all of ids. Rules end when no pair is frequent, or symbols of 16 bits are used up (of 32, where the ids
    alone need them)."""
    s = ids.astype(np.int32)
    room = (1 << 16) - first if first < (1 << 16) else (1 << 31) - first
    rules, lengths = [np.zeros((0, 2), np.int64)], np.ones(0, np.int64)
    mask, made = (1 << TABLE_BITS) - 1, 0
    # Where a pair begins that can be frequent: one that has a new symbol, or was frequent before. All others only grow rarer.
    open_ = np.ones(len(s), bool)
    while len(s) >= 2 * least and made < room:
        at = np.flatnonzero(open_[:-1])
        pair = (s[at].astype(np.int64) << 32) | s[at + 1]
        # A place of the table counts all pairs that fall on it, so no frequent pair is missed; those on full places are counted
        # one by one.
        if len(at) > mask >> 3:
            place = ((pair * -7046029254386353131) >> 24) & mask
            full = (np.bincount(place, minlength=mask + 1) >= least)[place]
            at, pair = at[full], pair[full]
        coded = pa.array(pair).dictionary_encode()
        of, found = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        counts = np.bincount(of, minlength=len(found))
        many = counts >= least
        if not many.any():
            break
        frequent = np.flatnonzero(many)
        frequent = frequent[np.lexsort((found[frequent], -counts[frequent]))][: room - made]
        here = many[of]
        at, of = at[here], of[here]
        open_[:] = False
        open_[at] = True
        order = np.full(len(found), len(frequent), np.int32)
        order[frequent] = np.arange(len(frequent), dtype=np.int32)
        ranked = order[of]
        # In a run of one symbol every other pair counts.
        twins = np.flatnonzero(s[at] == s[at + 1])
        if len(twins):
            places = at[twins]
            starts = np.flatnonzero(np.concatenate([[True], np.diff(places) != 1]))
            runs = np.diff(np.concatenate([starts, [len(places)]]))
            ranked[twins[(np.arange(len(places)) - np.repeat(starts, runs)) % 2 == 1]] = len(frequent)
        rank = np.full(len(s) + 1, len(frequent), np.int32)  # the last stands for both ends
        rank[at] = ranked
        chosen = (ranked < len(frequent)) & (ranked < rank[at - 1]) & (ranked <= rank[at + 1])
        used = np.bincount(ranked[chosen], minlength=len(frequent)) >= 3
        chosen &= used[np.minimum(ranked, len(frequent) - 1)]
        if not chosen.any():
            break
        number = np.cumsum(used) - 1 + first + made
        at = at[chosen]
        s[at] = number[ranked[chosen]]
        open_[at] = True
        open_[at[at > 0] - 1] = True
        left = np.ones(len(s), bool)
        left[at + 1] = False
        s, open_ = s[left], open_[left]
        new = found[frequent[used]]
        new = np.stack([new >> 32, new & 0xFFFFFFFF], 1)
        parts = np.ones(new.shape, np.int64)
        deep = new >= first
        parts[deep] = lengths[new[deep] - first]
        rules.append(new)
        lengths = np.concatenate([lengths, parts.sum(1)])
        made += len(new)
    return Grammar(first, np.concatenate(rules), lengths, s.astype(np.uint32))


def to_row(bucket: int, shard: int, start: int, docs: list[tuple[int | None, np.ndarray]], first: int) -> dict:
    ids = np.concatenate([x for _, x in docs])
    g = compress(ids, first)
    width = 2 if first + len(g.rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    return {
        "bucket": bucket, "shard": shard, "start": start, "n_docs": len(docs), "n_tokens": len(ids),
        "doc_ids": np.array([i or 0 for i, _ in docs], "<i8").tobytes(), "doc_nulls": bytes(i is None for i, _ in docs), "doc_tokens": np.array([len(x) for _, x in docs], "<u4").tobytes(),
        "first": first, "width": width, "rules": g.rules.astype(kind).tobytes(), "lengths": g.lengths.astype("<u4").tobytes(), "symbols": g.symbols.astype(kind).tobytes(),
    }


class Shard:
    """A row read back."""

    def __init__(self, row: dict):
        kind = f"<u{row['width']}"
        nulls = np.frombuffer(row["doc_nulls"], np.uint8)
        self.doc_ids = [None if n else int(i) for i, n in zip(np.frombuffer(row["doc_ids"], "<i8"), nulls)]
        self.ends = np.cumsum(np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64))
        read = lambda k: np.frombuffer(row[k], kind).astype(np.uint32)
        self.grammar = Grammar(row["first"], read("rules").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4").astype(np.int64), read("symbols"))
        self.symbol_ends = np.cumsum(self.grammar.sizes())

    def all_ids(self) -> np.ndarray:
        """Each symbol is expanded once and copied to its places, unless a table of all symbols is larger than the text."""
        g = self.grammar
        if 4 * (g.first + int(g.lengths.sum())) > self.symbol_ends[-1:].sum():
            return g.expand(g.symbols)
        each = np.concatenate([np.arange(g.first, dtype=np.uint32), g.expand(np.arange(g.first, g.first + len(g.rules), dtype=np.uint32))])
        ends = np.concatenate([np.arange(g.first + 1), g.first + np.cumsum(g.lengths)]) * 4
        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(each.astype("<u4").tobytes())])
        return np.frombuffer(table.take(pa.array(g.symbols)).buffers()[2], "<u4")

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document alone."""
        return self.grammar.slice(int(self.ends[i - 1]) if i else 0, int(self.ends[i]), self.symbol_ends)


def encoded(batches: Iterator[pa.RecordBatch], encode) -> Iterator[list[tuple]]:
    """(bucket, doc_id, ids) of the rows, in order, in lists of bounded text."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(ends // BATCH_CHARS)) + 1).tolist(), b.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            part = b.slice(start, stop - start)
            yield list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encode(part.column(2))))


def write_shards(docs: DataFrame, out: str, path: str, end_id: int = 1, shard_tokens: int = SHARD, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes all documents and writes the shard table to out.

    Texts are dealt once, by ranges of doc_id that hold about as many rows each; every range is one run of shards, encoded
    and compressed by the task that holds it. A lost task writes its shards again.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    n = partitions(spark)
    rows = rows.withColumn("bucket", bucket_of(F.col("doc_id"), range_bounds(rows, "doc_id", 4 * n)))
    first = len(vocabulary(path).tokens)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_batch
        end = np.array([end_id], np.uint32)
        schema = pa.schema(FIELDS)
        bucket, shard, start, held, size = None, 0, 0, [], 0

        def closed() -> pa.RecordBatch:
            row = to_row(bucket, shard, start, held, first)
            return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in FIELDS], schema=schema)

        for at_ids in encoded(batches, encode):
            for at, doc_id, ids in at_ids:
                if held and (at != bucket or size >= shard_tokens):
                    yield closed()
                    shard, start, held, size = shard + 1, start + size, [], 0
                if at != bucket:
                    bucket, shard, start = at, 0, 0
                ids = np.concatenate([ids, end])
                held.append((doc_id, ids))
                size += len(ids)
        if held:
            yield closed()

    dealt = rows.select("bucket", "doc_id", "text").repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id", "text")
    dealt.mapInArrow(work, DDL).write.option("compression", "snappy").parquet(out)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit), from the files alone.

    Shards know their place in their range; the ids of the ranges before come from one number a range (a few for each
    shuffle partition, whatever the data's size), which is all that is sent to the executors.
    """
    shards = spark.read.parquet(path)
    base, before = {}, 0
    for bucket, n in sorted(map(tuple, shards.groupBy("bucket").agg(F.sum("n_tokens")).collect())):
        base[bucket], before = before, before + n
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(j)[i].as_py() for j, (k, _) in enumerate(FIELDS)}
                shard = Shard(row)
                ends = shard.ends
                data = shard.all_ids().astype("<u4").tobytes()
                starts = np.concatenate([[0], ends[:-1]])
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype("<i4").tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + row["start"] + base[row["bucket"]]), ids], schema=schema)

    return shards.select(*[k for k, _ in FIELDS]).mapInArrow(work, "doc_id long, start long, ids binary")
