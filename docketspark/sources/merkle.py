"""A dataset's digest as a tree over ranges of its key, so that no task sees all rows and a change recomputes only its range.

A leaf covers WIDTH neighbouring integer keys: the SHA-256 of its rows' digests in the order of key and digest. A node covers WIDTH
nodes below: the SHA-256 of their digests in order; the root covers the first level of WIDTH nodes or fewer (flat_root: all leaves). Leaves without rows and
nodes without leaves do not occur. Each level is one
aggregation over groups of WIDTH members at most (more only where a key repeats). Rows without a key count as key 0. An empty
table has the digest of nothing.
"""

from __future__ import annotations

import hashlib

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

WIDTH = 256
EMPTY = hashlib.sha256(b"").hexdigest()


def row_digest(rows: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)


def leaf_of(key: str) -> Column:
    return F.floor(F.coalesce(F.col(key).cast("long"), F.lit(0)) / WIDTH).cast("long")


def combined(rows: DataFrame, parent: Column, order: str) -> DataFrame:
    """node, digest of rows (order, digest) by parent."""
    own = F.sort_array(F.collect_list(F.struct(order, "digest")))
    return rows.groupBy(parent.alias("node")).agg(F.sha2(F.array_join(F.transform(own, lambda x: x["digest"]), ""), 256).alias("digest"))


def leaves(rows: DataFrame, key: str, digest: Column | None = None) -> DataFrame:
    """node, digest of each range of keys that has rows."""
    own = rows.select(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("key"), (row_digest(rows) if digest is None else digest).alias("digest"))
    return combined(own, leaf_of("key"), "key")


def root(level: DataFrame) -> str:
    """The digest of the tree over leaves."""
    level = stored(level, "leaves")
    while (n := level.count()) > WIDTH:
        level = stored(combined(level, F.floor(F.col("node") / WIDTH).cast("long"), "node"), "level")
    return combined(level, F.lit(0).cast("long"), "node").first().digest if n else EMPTY


def tree_hash(rows: DataFrame, key: str, digest: Column | None = None) -> str:
    return root(leaves(rows, key, digest))


def flat_root(level: DataFrame) -> DataFrame:
    """digest: the SHA-256 of all leaves' digests in order, one level above them however many there are. SHA-256 is a stream, so one
    task reads the sorted digests (64 characters for WIDTH keys) and holds a batch of them at a time. The leaves are computed before,
    by all tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashlib.sha256()
        for b in batches:
            h.update("".join(b.column(0).to_pylist()).encode())
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], names=["digest"])

    return stored(level, "leaves").repartition(1).sortWithinPartitions("node").select("digest").mapInArrow(work, "digest string").agg(F.coalesce(F.max("digest"), F.lit(EMPTY)).alias("digest"))


def updated(before: DataFrame, rows: DataFrame, key: str, changed: DataFrame, digest: Column | None = None) -> DataFrame:
    """The leaves of rows, from the leaves before and the keys (column of the same name) that were added, changed or removed: only
    their ranges are read and hashed anew."""
    touched = changed.select(leaf_of(key).alias("node")).distinct()
    own = rows.select("*", (row_digest(rows) if digest is None else digest).alias("row_digest_"), leaf_of(key).alias("node_")).join(touched, F.col("node_") == F.col("node"), "left_semi")
    return before.join(touched, "node", "left_anti").unionByName(leaves(own, key, F.col("row_digest_")))
