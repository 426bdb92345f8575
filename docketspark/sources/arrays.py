"""JSON arrays of any size, read by many tasks.

The file is read as text that is cut at closing braces, which can be split over tasks anywhere. Where a record ends depends on all
that comes before: whether a place is inside a string, behind a backslash, and how deep it is nested. That is a small automaton,
and what a stretch of bytes does to its state is a function that can be found without knowing the state it is entered with. So
the first pass gives one such function for each split (a row of numbers), these are composed in the order of the file (a running
product of a few numbers a split, done by the driver), and the second pass cuts records with the state that each split begins in.
Records that lie in several splits are put together from their parts. Both passes work on whole batches of bytes with numpy.

Elements have to be objects. Anything else, and text before, between or after the records that does not belong there, is an error
that names the file and the byte. Several files are several arrays. White space and a byte order mark are skipped; an empty file
and an empty array have no records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a place may be: outside strings, inside one, inside one behind a backslash.
OUTSIDE, INSIDE, ESCAPED = range(3)
#: Bytes that are looked at at once: a pass takes some ninety times as many while it does, whatever the size of a batch of rows.
CHUNK = 1 << 18
_BEFORE = {True: re.compile(rb"(?:\xef\xbb\xbf)?\s*\[\s*(?=\{)"), False: re.compile(rb"\s*,\s*(?=\{)")}
_LAST = {True: re.compile(rb"(?:\xef\xbb\xbf)?\s*(?:\[\s*\]\s*)?"), False: re.compile(rb"\s*\]\s*")}


@dataclass(frozen=True)
class Effect:
    """What a stretch of bytes does: for each kind of place it may begin at, the kind it ends at and how much deeper that is."""

    ends: tuple[int, int, int]
    deeper: tuple[int, int, int]
    size: int

    def then(self, other: Effect) -> Effect:
        return Effect(tuple(other.ends[e] for e in self.ends), tuple(d + other.deeper[e] for e, d in zip(self.ends, self.deeper)), self.size + other.size)


NOTHING = Effect((OUTSIDE, INSIDE, ESCAPED), (0, 0, 0), 0)


def marked(data: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(outside: whether each byte lies outside strings, steps: +1 and -1 at brackets, where the bytes end) from a first kind of place."""
    n = len(data)
    at = np.arange(n)
    slash = data == 92
    last = np.maximum.accumulate(np.where(slash, -1, at))  # the last byte up to here that is no backslash
    run = np.where(slash, at - last, 0)  # backslashes up to here
    run[(last < 0) & slash] += kind == ESCAPED
    escaped = np.zeros(n, bool)
    escaped[1:] = run[:-1] % 2 == 1
    if n:
        escaped[0] = kind == ESCAPED
    quotes = np.cumsum((data == 34) & ~escaped)
    outside = (quotes + (kind != OUTSIDE)) % 2 == 0
    steps = np.isin(data, (91, 123)).astype(np.int64) - np.isin(data, (93, 125))
    end = kind if not n else OUTSIDE if outside[-1] else ESCAPED if run[-1] % 2 else INSIDE
    return outside, steps, end


def effect_of(data: np.ndarray) -> Effect:
    if not len(data):
        return NOTHING
    found = [marked(data, kind) for kind in (OUTSIDE, INSIDE, ESCAPED)]
    return Effect(tuple(end for _, _, end in found), tuple(int(steps[outside].sum()) for outside, steps, _ in found), len(data))


def chunks(values: pa.Array) -> Iterator[pa.Array]:
    """Runs of values (strings or bytes) of CHUNK bytes, or of a single value that has more."""
    before = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    low = 0
    while low < len(values):
        high = max(low + 1, int(np.searchsorted(before, (before[low - 1] if low else 0) + CHUNK, side="right")))
        yield values.slice(low, high - low)
        low = high


def parted(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of CHUNK bytes of a column."""
    for batch in batches:
        low = 0
        for some in chunks(batch.column(column)):
            yield batch.slice(low, len(some))
            low += len(some)


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[np.ndarray]]]:
    """((file, start of the split), its bytes in order) of rows (value, path, start); the brace after each row is put back."""

    def parts() -> Iterator[tuple[tuple[str, int], np.ndarray]]:
        for batch in batches:
            values = batch.column(0).cast(pa.binary())
            starts, paths = batch.column(2).to_numpy(), batch.column(1).dictionary_encode()
            codes = paths.indices.to_numpy()
            cuts = [0, *(np.flatnonzero((starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])) + 1).tolist(), len(starts)]
            for a, b in zip(cuts, cuts[1:]):
                for some in chunks(values.slice(a, b - a)):
                    data = np.frombuffer(b"}".join(some.to_pylist()) + b"}", np.uint8)
                    for low in range(0, len(data), CHUNK):
                        yield (paths.dictionary[codes[a]].as_py(), int(starts[a])), data[low : low + CHUNK]

    for key, run in groupby(parts(), lambda x: x[0]):
        yield key, (data for _, data in run)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def effects(rows: DataFrame) -> list[tuple[str, int, Effect]]:
    """(path, start, effect) of every split, in the order of the files: a few numbers each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start), parts in stretches(batches):
            e = NOTHING
            for data in parts:
                e = e.then(effect_of(data))
            yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "size": e.size, "ends": list(e.ends), "deeper": list(e.deeper)}], schema)

    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("ends", pa.list_(pa.int32())), ("deeper", pa.list_(pa.int64()))])
    found = rows.mapInArrow(work, "path string, start long, size long, ends array<int>, deeper array<long>").collect()
    return sorted((r.path, r.start, Effect(tuple(r.ends), tuple(r.deeper), r.size)) for r in found)


def entries(found: list[tuple[str, int, Effect]]) -> dict[tuple[str, int], tuple[int, int, int, bool]]:
    """(kind of place, depth, offset, whether the file ends with it) that each split begins with."""
    out, before = {}, NOTHING
    for i, (path, start, effect) in enumerate(found):
        if not i or found[i - 1][0] != path:
            before = NOTHING
        last = i + 1 == len(found) or found[i + 1][0] != path
        out[path, start] = (before.ends[OUTSIDE], before.deeper[OUTSIDE], before.size, last)
        before = before.then(effect)
    return out


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """path, at (byte in the file), value (the record's text), problem (null if all is well): one row for each record, and one for
    what follows the last if that is wrong."""
    rows = pieces(spark, path)
    known = entries(effects(rows))
    schema = pa.schema([("path", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, start), parts in stretches(batches):
            kind, depth, offset, _ = known[name, start]
            first, held, begun, split = True, [], offset, offset
            for data in parts:
                outside, steps, kind = marked(data, kind)
                depths = depth + np.cumsum(np.where(outside, steps, 0))
                ends = np.flatnonzero((data == 125) & outside & (depths == 1)) + 1
                depth = int(depths[-1])
                raw, out, done = data.tobytes(), [], 0
                for end in ends.tolist():
                    # part 0: the end of a record that may have begun before; 1: a record that begins behind another.
                    out.append({"path": name, "split": split, "at": begun, "part": 0 if first else 1, "data": b"".join([*held, raw[done:end]])})
                    first, held, done, begun = False, [], end, offset + end
                held.append(raw[done:])
                offset += len(data)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
            # part 2: what follows the last record; 3: a split in which none ends.
            yield pa.RecordBatch.from_pylist([{"path": name, "split": split, "at": begun, "part": 3 if first else 2, "data": b"".join(held)}], schema)

    cut = rows.mapInArrow(work, "path string, split long, at long, part int, data binary")
    whole = cut.where("part = 1").select("path", "at", "data", F.lit(False).alias("last"))
    # A record's parts: what follows the last record of a split, splits in which none ends, the first end of the next.
    order = Window.partitionBy("path").orderBy("split", "part")
    ends = F.sum(F.when(F.col("part") == 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = cut.where("part <> 1").withColumn("record", F.coalesce(ends, F.lit(0)))
    joined = numbered.groupBy("path", "record").agg(F.sort_array(F.collect_list(F.struct("split", "part", "data"))).alias("parts"), F.min("at").alias("at"), F.max(F.col("part") == 0).alias("ended"))
    glued = joined.select("path", "at", F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["data"])).alias("data"), (~F.col("ended")).alias("last"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("value", pa.binary()), ("problem", pa.string())])
        for batch in parted(batches, 2):
            out = []
            for name, at, data, last in zip(*(c.to_pylist() for c in batch.columns)):
                if last:
                    rest = data[:-1]  # the brace that was put back behind the file's end
                    if not _LAST[at == 0].fullmatch(rest):
                        bad = len(re.match(rb"\s*,?\s*", rest)[0])
                        out.append({"path": name, "at": at + bad, "value": rest, "problem": f"{name}: the array is not closed or something else follows, at byte {at + bad}"})
                elif m := _BEFORE[at == 0].match(data):
                    out.append({"path": name, "at": at + m.end(), "value": data[m.end() :], "problem": None})
                else:
                    out.append({"path": name, "at": at, "value": data, "problem": f"{name}: no object of an array, at byte {at}"})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    found = whole.unionByName(glued).mapInArrow(check, "path string, at long, value binary, problem string")
    return found.select("path", "at", F.col("value").cast("string").alias("value"), "problem")


def read_array(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """The records of JSON arrays. strict: what is broken fails the job with its file and byte; otherwise it is left out."""
    rows = array_records(spark, path)
    read = rows.select("*", F.from_json("value", f"{schema}, broken_record string", {"columnNameOfCorruptRecord": "broken_record"}).alias("r"))
    broken = F.col("problem").isNotNull() | F.col("r").isNull() | F.col("r.broken_record").isNotNull()
    if strict:
        said = F.coalesce("problem", F.concat("path", F.lit(": broken record at byte "), F.col("at").cast("string")))
        read = read.withColumn("r", F.when(broken, F.raise_error(said)).otherwise(F.col("r")))
    else:
        read = read.where(~broken)
    return read.select("r.*").drop("broken_record")
