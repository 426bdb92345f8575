"""A corpus from documents to training sequences: each stage is one operator at work on all that the stage before kept.

Null texts have no language and go in the first stage. Of rows with equal texts one stays, that with the largest id; rows without an id count
as smaller than all others. An empty table gives an empty result in every stage.
Columns besides those of documents pass through all stages but the last with their values, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.llm import bktree, exact_dedup, langid, packing, pii
from docketspark.llm.common import cleared, delete, scratch, table, tokenizer_path
from docketspark.llm.registry import fold

#: A document stays if its language has this share of it at least.
LEAST_SHARE = 0.5
#: Bytes of an Arrow batch: texts go to the Python workers in small pieces, so that neither side holds large buffers.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches; this changes no results. Each stage does it, as each may run in a session of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language (no letters), or without a language of at least half of their text, go. A language
    that is missing is filled in."""
    small_batches(spark)
    model = langid.train(docs, fold(4) != 2)
    found = langid.identify(docs.select(F.struct("*").alias("document"), "text"), model)
    kept = found.where((F.col("lang_pred") != langid.UND) & (F.col("share") >= LEAST_SHARE))
    own = lambda c: F.coalesce(F.col("document.lang"), F.col("lang_pred")) if c == "lang" else F.col(f"document.`{c}`")
    return kept.select(*[own(c).alias(c) for c in docs.columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect the one with the smallest doc_id stays."""
    small_batches(spark)
    return bktree.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind in brackets; n_chars follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates), ("pii", personal_data), ("packing", pack)]

#: SQL can express neither the language model nor hash votes nor BPE; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next. What a stage stores for itself is deleted
    when its result is written, and that when the next stage's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        place = scratch(spark, name)
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(place)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(place), place
    return STAGES[-1][1](spark, docs, sf_dir)
