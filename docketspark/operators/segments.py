"""A lemma index that grows and shrinks: segments for arriving documents, merged level by level, and a list of what was removed.

A segment is a table of positions (lemma, key, pos), sorted by lemma, so that Parquet statistics skip what a lookup does not need. The
log says which segments there are: a row is appended when a segment is complete, so a writer that dies leaves nothing half done,
and a merged segment names those that it replaces. Removing documents appends their ids with the last segment number that they are
removed from; a document that comes again later is in a later segment and stays. Merging writes FANOUT segments of one level as one of
the next, without what was removed, so each row is rewritten about as often as there are levels. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lemma import KEY, occurrences

FANOUT = 4
LOG = "number long, level int, place string, replaces array<long>"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def live(spark: SparkSession, path: str) -> list:
    """The segments (number, level, place) that count, by number; a handful."""
    rows = _table(spark, f"{path}/log", LOG).collect()
    gone = {n for r in rows for n in r.replaces}
    return sorted((r for r in rows if r.number not in gone), key=lambda r: r.number)


def _last(spark: SparkSession, path: str) -> int:
    return max((r.number for r in _table(spark, f"{path}/log", LOG).select("number").collect()), default=0)


def _write(spark: SparkSession, path: str, rows: DataFrame, level: int, replaces: Sequence[int] = ()) -> int:
    number, place = _last(spark, path) + 1, f"segments/{uuid.uuid4().hex}"
    # The files of a new segment are sorted each on its own, so its tokens are made once and not shuffled; merging deals them by ranges.
    dealt = rows.repartitionByRange("lemma", *rows.columns[1:-1]) if level else rows
    dealt.sortWithinPartitions("lemma").write.parquet(f"{path}/{place}")
    spark.createDataFrame([(number, level, place, list(replaces))], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return number


def add(spark: SparkSession, path: str, paragraphs: DataFrame, lemma_of: Callable[[Column], Column] | None = None, text: str = "text", key: Sequence[str] = KEY, spaced: bool = False) -> int:
    """A segment of these paragraphs; its number. lemma_of: the dictionary as an expression over a form (the form itself without)."""
    of = lemma_of or (lambda x: x)
    rows = occurrences(paragraphs, text, key, spaced).select(of(F.col("form")).alias("lemma"), *key, "pos")
    return _write(spark, path, rows, 0)


def _removed(spark: SparkSession, path: str, document: DataFrame, name: str) -> DataFrame:
    kind = document.schema[name].dataType.simpleString()
    found = _table(spark, f"{path}/removed", f"{name} {kind}, upto long")
    return found.groupBy(name).agg(F.max("upto").alias("upto"))


def remove(spark: SparkSession, path: str, documents: DataFrame, name: str = "document_id") -> None:
    """The documents (column name) are no longer in any segment that there is now."""
    documents.select(name, F.lit(_last(spark, path)).cast("long").alias("upto")).distinct().write.mode("append").parquet(f"{path}/removed")


def positions(spark: SparkSession, path: str, name: str = "document_id", segments: list | None = None) -> DataFrame:
    """lemma, key, pos of all that is in the index. Filters on the lemma reach the scans of all segments."""
    own = live(spark, path) if segments is None else segments
    if not own:
        raise ValueError(f"no segment below {path}")
    rows = None
    for r in own:
        part = spark.read.parquet(f"{path}/{r.place}").withColumn("segment_number", F.lit(r.number))
        rows = part if rows is None else rows.unionByName(part)
    gone = _removed(spark, path, rows, name).withColumnRenamed(name, "removed_name")
    return rows.join(gone, (F.col(name) == F.col("removed_name")) & (F.col("segment_number") <= F.col("upto")), "left_anti").drop("segment_number")


def merge(spark: SparkSession, path: str, name: str = "document_id", fanout: int = FANOUT) -> int:
    """Merges as long as `fanout` segments are of one level; how many merges that took."""
    done = 0
    while True:
        levels: dict[int, list] = {}
        for r in live(spark, path):
            levels.setdefault(r.level, []).append(r)
        full = next((level for level in sorted(levels) if len(levels[level]) >= fanout), None)
        if full is None:
            return done
        chosen = levels[full][:fanout]
        _write(spark, path, positions(spark, path, name, chosen), full + 1, [r.number for r in chosen])
        done += 1
