"""Cases that arrive as files over time: an extension for growing corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import cases
from ..sources.cases import RAW


def arriving(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Raw decisions of JSON-lines files as they come in."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, delay: str = "1 day", forced: bool = False) -> StreamingQuery:
    """Normalizes what arrives and appends it to Parquet; a document that comes again within the delay is left out. Runs until
    what is there has been read."""
    fresh = arriving(spark, path).withColumns({"seen_at": F.current_timestamp(), "document": F.col("ids.document_id")}).withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["document"])
    rows = cases(fresh, forced=forced)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str, kind: str, size: str, delay: str) -> DataFrame:
    """Events by window and kind, for streams and tables alike."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    w = rows.groupBy(F.window(time, size), kind).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("window_start"), kind, "n")
