"""Exact deduplication by a stream over keyed state that is kept on disk and never expires.

Arrivals (digest, doc_id, locator: one small row for each document) are written to the shared folder and read as a stream. A
locator is the file and the number of the row in it, so it finds the content again; rows that are no plain scan of Parquet files
are written to one first. The state has one entry for each digest: the largest doc_id seen, the locator of that row, and how many
rows came. It lives in RocksDB next to the executors' disks, with its changes in the state folder, so a lost executor's state
is restored, and a later run with the same state folder goes on where this one stopped. Rows of one digest are combined on
the map side before they reach the state, so a text that makes up a third of the input is one entry that each task updates once.

A hit on a digest is no proof. The contents of all rows whose digest the state has seen more than once are read by their
locators, and the smallest and the largest text of each digest have to be the same bytes. Should a digest ever collide, the
next digest function is taken for the whole input.

DataFrame functions and Structured Streaming only. Null texts count as empty. Of equal texts the row with the largest doc_id
stays; among rows with equal ids and texts the one with the largest locator; a null id counts as smaller than all others. An
empty table gives an empty result. Other columns of the input are ignored by deduplicate() and kept by drop_duplicates().
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, text_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the stream's own session. Many small stores: none reserves disk for its logs, all of an executor share bounded
#: memory, a commit is one file of changes, and files are handled by the plain file system interface, which starts no helper
#: processes for links and permissions.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
}
FIRST = -(1 << 63)
ARRIVAL = "doc_id long, digest binary, file long, row long"
ENTRY = "digest binary, keep_id long, keep_file long, keep_row long, group_size long, batch int"

Digest = Callable[[Column], Column]
DIGESTS: tuple[Digest, ...] = (lambda t: F.unhex(F.sha2(t, 256)), lambda t: F.unhex(F.sha2(t, 512)))


def bare_scan(docs: DataFrame) -> bool:
    """Whether every row of docs is a row of a file of its own: a scan with nothing but filters and projections over it."""
    try:
        node = docs._jdf.queryExecution().analyzed()
    except AttributeError:  # a session without a plan to look at
        return False
    while (name := node.getClass().getSimpleName()) in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return name == "LogicalRelation"


def located(docs: DataFrame) -> DataFrame:
    """docs with dedup_path, dedup_file (the path's hash) and dedup_row: where each row lies. What is more than a filtered scan
    (joins, explode, samples may give a file's row several times) is written first."""

    def places(rows: DataFrame) -> DataFrame:
        path = F.col("_metadata.file_path")
        return rows.select("*", path.alias("dedup_path"), F.xxhash64(path).alias("dedup_file"), F.col("_metadata.row_index").alias("dedup_row"))

    if bare_scan(docs):
        try:
            return places(docs)
        except AnalysisException:  # no rows of Parquet files
            pass
    return places(stored(docs, "content"))


def packed(docs: DataFrame) -> DataFrame:
    """docs as one column, so that no name of theirs meets one of this module's."""
    return docs.select(F.struct("*").alias("document"))


def keyed_state(stream: DataFrame) -> DataFrame:
    """The state over a stream of arrivals: digest, keep_id, keep_file, keep_row, group_size. No watermark, so nothing expires."""
    order = F.struct(F.coalesce("doc_id", F.lit(FIRST)), "file", "row")
    best = F.max_by(F.struct("file", "row"), order).alias("at")
    out = stream.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), best, F.count(F.lit(1)).alias("group_size"))
    return out.select("digest", "keep_id", F.col("at.file").alias("keep_file"), F.col("at.row").alias("keep_row"), "group_size")


def run_stream(spark: SparkSession, arrivals: str, state: str, out: str, files_per_batch: int | None = None) -> None:
    """Feeds all arrivals that the checkpoint `state` has not seen through the keyed state; every batch adds the entries that
    it changed to `out`. Entries only grow, so the latest of each digest is its present one."""
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    for k, v in SETTINGS.items():
        own.conf.set(k, v)
    reader = own.readStream.schema(ARRIVAL)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    changed = keyed_state(reader.parquet(arrivals))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    changed.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def entries(spark: SparkSession, out: str) -> DataFrame:
    """The present entry of each digest."""
    rows = spark.read.schema(ENTRY).parquet(out)
    last = F.max_by(F.struct("keep_id", "keep_file", "keep_row", "group_size"), "batch").alias("e")
    return rows.groupBy("digest").agg(last).select("digest", "e.*")


def contents(spark: SparkSession, paths: DataFrame, wanted: DataFrame, text_column: str) -> DataFrame:
    """text, file, row of the files (path, file) that hold wanted rows (file, row)."""
    names = [r.path for r in paths.join(wanted.select("file").distinct(), "file", "left_semi").select("path").distinct().collect()]
    if not names:
        return wanted.select(F.lit("").alias("text"), "file", "row").limit(0)
    read = located(spark.read.parquet(*names))
    return read.select(text_of(text_column).alias("text"), F.col("dedup_file").alias("file"), F.col("dedup_row").alias("row"))


def unequal(texts: DataFrame, hits: DataFrame) -> bool:
    """Whether some group of equal digests holds different texts. texts: text, file, row; hits: digest, file, row of all rows of
    groups of several.

    The join is on the locator, which no group of copies makes hot, and each task reduces a group to its smallest and largest
    text before anything of the group meets."""
    checked = texts.join(hits, ["file", "row"]).groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return not checked.where("low <> high").isEmpty()


def groups(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text", digests: tuple[Digest, ...] = DIGESTS, files_per_batch: int | None = None, state: str | None = None) -> DataFrame:
    """doc_id, digest, sha (SHA-256), file, row, keep_id, group_size, kept: one row for each of rows, which located() gave.

    state: a folder of the caller's that later runs over further rows go on with; groups then count the rows of all runs."""
    spark = rows.sparkSession
    own = rows.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"), F.col("dedup_file").alias("file"), F.col("dedup_row").alias("row"))
    for number, digest in enumerate(digests):
        place = f"{state or scratch(spark, 'dedup')}/digest{number}"
        run = uuid.uuid4().hex
        own.select("doc_id", digest(F.col("text")).alias("digest"), "file", "row", DIGESTS[0](F.col("text")).alias("sha")).write.parquet(f"{place}/arrivals/run={run}")
        rows.select(F.col("dedup_path").alias("path"), F.col("dedup_file").alias("file")).distinct().write.parquet(f"{place}/paths/run={run}")
        run_stream(spark, f"{place}/arrivals/*", f"{place}/state", f"{place}/entries", files_per_batch)
        present = stored(entries(spark, f"{place}/entries"), "entries")  # so that the join can split a frequent digest
        arrived = spark.read.schema(ARRIVAL + ", sha binary").parquet(f"{place}/arrivals/run={run}").join(present, "digest")
        same = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
        out = arrived.select("doc_id", "digest", "sha", "file", "row", "keep_id", "group_size", same.alias("kept"))
        several = present.where("group_size > 1").select("digest")
        texts = own.select("text", "file", "row")
        hits = out.where("group_size > 1").select("digest", "file", "row")
        if state:
            before = spark.read.schema(ARRIVAL + ", run string").parquet(f"{place}/arrivals").where(F.col("run") != run)
            earlier = before.join(several, "digest", "left_semi").select("digest", "file", "row")
            texts = texts.union(contents(spark, spark.read.parquet(f"{place}/paths"), earlier, text_column))
            hits = hits.union(earlier)
        if not unequal(texts, hits):
            return out
    raise RuntimeError("every digest function gave different texts the same digest")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digests: tuple[Digest, ...] = DIGESTS, state: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    rows = located(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
    out = groups(rows, "doc_id", "text", digests, state=state)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digests: tuple[Digest, ...] = DIGESTS, state: str | None = None) -> DataFrame:
    """docs without the rows that are dropped. Only these rows' locators meet the texts."""
    rows = located(packed(docs))
    gone = groups(rows, f"document.`{id_column}`", f"document.`{text_column}`", digests, state=state).where("not kept").select(F.col("file").alias("gone_file"), F.col("row").alias("gone_row"))
    gone = stored(gone, "gone")
    same = (rows.dedup_file == gone.gone_file) & (rows.dedup_row == gone.gone_row)
    return rows.join(gone, same, "left_anti").select("document.*")
