"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

A piece of length n belongs to the class k = capacity // n: k pieces of that class fit into one sequence, whatever their
lengths within the class. Each worker keeps one open sequence for each class and closes it when it holds exactly k pieces,
so workers need nothing from each other and a document never waits for one of another partition.

Documents may be cut. One longer than the capacity gives whole sequences first. What remains goes to its class if it
nearly fills the class's slot (capacity // k); otherwise a piece that fills the next class's slot is cut off and the rest
is looked at again, so no class wastes more than WASTE of a sequence. The pieces in sequences that are still open when a
worker's rows end are laid end to end into full sequences; the last stretch is cut at powers of two, which need no padding.

Null texts count as empty. A document always has the end id, so each has one piece at least. Rows with equal ids are packed
as separate documents. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_of
from .vocab import encoder

#: A piece may leave this part of its slot empty.
WASTE = 1 / 64

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cut(length: int, capacity: int, waste: float = WASTE) -> list[tuple[int, int]]:
    """(class, piece length) of a document's pieces, in order."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        if slot - rest <= waste * slot:
            out.append((k, rest))
            break
        piece = capacity // (k + 1)
        out.append((k + 1, piece))
        rest -= piece
    return out


class Bins:
    """One worker's open sequences. Closed ones come out as rows (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple]] = {}

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for ids, doc_id, start, total in pieces:
            yield ids, doc_id, start, total, self.next, offset
            offset += len(ids)
        self.next += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for k, n in cut(len(ids), self.capacity):
            piece = (ids[start : start + n], doc_id, start, len(ids))
            start += n
            if k == 1:
                yield from self.close([piece])
                continue
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                yield from self.close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        left = sum(len(piece[0]) for piece in rest)
        held, room = [], 0
        for ids, doc_id, start, total in rest:
            while len(ids):
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    left -= room
                n = min(room, len(ids))
                held.append((ids[:n], doc_id, start, total))
                ids, start, room = ids[n:], start + n, room - n
                if not room:
                    yield from self.close(held)
                    held = []


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    One pass over the input's own partitions, without a shuffle. A sequence's id holds its partition's number in the upper bits.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        bins = Bins(capacity, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
        end = np.array([end_id], np.uint32)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            ids, doc, start, total, sequence, offset = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((doc, start, [len(i) for i in ids], [i.tobytes() for i in ids], total, sequence, offset), ARROW.types)], schema=ARROW)

        rows: list[tuple] = []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                rows.extend(bins.add(doc_id, np.concatenate([encode(text.as_py()), end])))
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
        rows.extend(bins.finish())
        if rows:
            yield batch(rows)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(lean(work), SCHEMA)
