"""What the operators share: tables, the shared folder, partition bounds, tokenizer files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cleared, delete, scratch, shared_dir, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(work):
    """A task's function over batches that gives the memory it no longer uses back to the system when it ends: workers stay for
    later tasks, and what they keep counts against the executor's."""
    import ctypes
    import functools
    import gc

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending cut points of an integer key, from one scan of that column."""
    if n < 2:
        return []
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """The number of cut points at or below the key (0 for null). Looked up in two steps: block, then cut in the block."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda a: F.size(F.filter(a, lambda x: x <= key))
    block = F.greatest(below(longs([b[0] for b in blocks])) - 1, F.lit(0))
    inside = below(F.element_at(F.array(*[longs(b) for b in blocks]), block + 1))
    return F.coalesce(block * step + inside, F.lit(0))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def text_of(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
