"""Repeatable samples by a counter-based generator: the i-th number is a formula of the seed and i.

The generator adds a constant to its state for each number, so the state behind i numbers is seed + i times the constant, and no
number has to wait for the one before. Choosing n of N places by a shuffle from the end swaps place i with a place at or below it; of
that only the swaps matter that bring something to the first n places, and what they bring is found by following each of these n
places up: to the least i that was swapped with it, from there to the least that was swapped with that, and so on. So all draws
are made in parallel, reduced to one partner a place, and followed by joins of n rows, about as many as the logarithm of N.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

# Fixed values of the generator.
STEP, WORD = 0x6D2B79F5, 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, within the range of a long."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftright(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(WORD))


def uniform(seed: int, i: Column) -> Column:
    """The i-th number (from 0) of the seed, in [0, 1), as the generator gives it up to 4.9 million numbers. Beyond, where floating
    point would round the state, it is that of 32-bit arithmetic."""
    step = _times((i.cast("long") + 1).bitwiseAND(F.lit(WORD)), F.lit(STEP).cast("long"))
    t = (F.lit(seed & WORD).cast("long") + step).bitwiseAND(F.lit(WORD))
    r = _times(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(1).cast("long")))
    more = _times(r.bitwiseXOR(F.shiftright(r, 7)), r.bitwiseOR(F.lit(61).cast("long")))
    r = r.bitwiseXOR((r + more).bitwiseAND(F.lit(WORD)))
    return r.bitwiseXOR(F.shiftright(r, 14)) / F.lit(4294967296.0)


def seed_of(digest: str) -> int:
    """The first eight hexadecimal digits of a digest; 1234abcd without any."""
    return int(re.sub("[^a-fA-F0-9]", "", digest or "")[:8] or "1234abcd", 16)


def places(spark, total: int, n: int, seed: int) -> DataFrame:
    """place: n distinct of 0 to total - 1 (all, if fewer)."""
    n = max(0, min(total, n))
    own = spark.range(n).select(F.col("id").alias("start"), F.col("id").alias("place"))
    if n == total or not n:
        return own.select("place")
    i = F.col("id")
    drawn = spark.range(n, total).select(i.alias("from"), F.floor(uniform(seed, F.lit(total - 1).cast("long") - i) * (i + 1)).cast("long").alias("place"))
    partner = stored(drawn.groupBy("place").agg(F.min("from").alias("from")), "draws")
    while True:
        moved = stored(own.join(partner, "place", "left").select("start", F.coalesce("from", "place").alias("place"), F.col("from").isNotNull().alias("moved")), "places")
        own = moved.select("start", "place")
        if moved.where("moved").isEmpty():
            return own.select("place")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with `number`, from 0 in the order of a column of distinct values. Rows are dealt by ranges of it; one number a range
    goes to the driver."""
    from pyspark.sql import Window

    dealt = stored(rows.repartitionByRange(F.col(order)).select("*", F.spark_partition_id().alias("range_number")), "ranges")
    before, base = 0, []
    for part, n in sorted(map(tuple, dealt.groupBy("range_number").count().collect())):
        base += [F.lit(part), F.lit(before).cast("long")]
        before += n
    if not base:
        return rows.select("*", F.lit(0).cast("long").alias("number"))
    own = F.row_number().over(Window.partitionBy("range_number").orderBy(order)) - 1
    return dealt.withColumn("number", own + F.element_at(F.create_map(*base), F.col("range_number"))).drop("range_number")


def sample(rows: DataFrame, order: str, n: int, seed: int) -> DataFrame:
    """n rows, as the shuffle of the seed chooses them from the rows in the order of a column of distinct values."""
    found = numbered(rows, order)
    chosen = places(rows.sparkSession, rows.count(), n, seed)
    return found.join(chosen, found.number == chosen.place).select(*rows.columns)
