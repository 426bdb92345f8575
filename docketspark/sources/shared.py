"""Tables that an operator writes for itself, below the folder that driver and executors share, and their deletion."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a local session gets a temporary folder; a cluster has to name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the executors share")
        named = tempfile.mkdtemp(prefix="docketspark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    place = f"{shared_dir(spark)}/docketspark/{what}-{uuid.uuid4().hex}"
    _WRITTEN.append(place)
    return place


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage and computes it once."""
    place = scratch(df.sparkSession, what)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes what is stored within the block when it ends: for callers that write a result out before that."""
    first = len(_WRITTEN)
    try:
        yield
    finally:
        while len(_WRITTEN) > first:
            delete(spark, _WRITTEN.pop())
