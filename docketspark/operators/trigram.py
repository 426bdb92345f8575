"""A written index for substring search: which blocks of rows hold which three letters.

Rows are written in blocks of BLOCK, in an order that keeps a case together, with pages as small as blocks, so that Parquet's column
index skips the pages of other blocks. Postings are rows (gram, block) sorted by gram, so a lookup reads the pages of its grams
only. A text of three letters or more can only be where all its grams are; a search looks up the rarest grams of each of its texts,
evaluates the query over the grams of each block (NOT and fields say nothing there), and reads the blocks that are left. The rows
there are tested as always, so results are those of a scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .query import Both, Either, Fields, Filters, Query, Text, condition, score

#: Rows of a block (a power of two), grams that are looked up for a text, and ranges of blocks that a scan is given at most.
BLOCK, RAREST, RANGES = 64, 4, 200
_SHIFT = BLOCK.bit_length() - 1


def grams(text: Column) -> Column:
    """The distinct stretches of three letters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def grams_of(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def write(rows: DataFrame, path: str, order: Sequence[str], text: str = "text_legal") -> None:
    """rows and postings below path."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = dealt.withColumn("block", F.shiftright(F.monotonically_increasing_id(), _SHIFT))
    small = {"parquet.page.row.count.limit": str(BLOCK), "parquet.page.size.row.check.min": str(BLOCK), "parquet.page.size.row.check.max": str(BLOCK)}
    numbered.write.mode("overwrite").options(**small).parquet(f"{path}/rows")
    own = spark.read.parquet(f"{path}/rows").select("block", F.explode(grams(F.col(text))).alias("gram")).distinct()
    own.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").option("parquet.page.row.count.limit", "2000").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")


def rarest(spark: SparkSession, path: str, texts: Sequence[str]) -> dict[str, list[str]]:
    """For each text the RAREST of its grams that fewest blocks hold; none for texts of less than three letters."""
    every = sorted({g for t in texts for g in grams_of(t)})
    n = {r.gram: r.n for r in spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(*every)).collect()} if every else {}
    return {t: sorted(grams_of(t), key=lambda g: (n.get(g, 0), g))[:RAREST] for t in texts}


def _possible(tree: object, has: Callable[[str], Column | None]) -> Column | None:
    """Whether a block may hold a row that the tree matches; None where it always may."""
    match tree:
        case Text():
            ways = [has(x) for x in dict.fromkeys([tree.norm, tree.legal or tree.norm])]
            return None if any(w is None for w in ways) else reduce(lambda a, b: a | b, ways)
        case Both():
            parts = [p for p in (_possible(tree.left, has), _possible(tree.right, has)) if p is not None]
            return reduce(lambda a, b: a & b, parts) if parts else None
        case Either():
            parts = [_possible(tree.left, has), _possible(tree.right, has)]
            return None if any(p is None for p in parts) else parts[0] | parts[1]
    return None


def candidates(spark: SparkSession, path: str, query: Query) -> DataFrame | None:
    """block: the blocks that may hold a match; None if the query gives no way to tell."""
    texts = sorted({x for t in query.texts for x in (t.norm, t.legal) if x})
    chosen = rarest(spark, path, texts)
    names = {g: f"g{i}" for i, g in enumerate(sorted({g for gs in chosen.values() for g in gs}))}
    has = lambda t: reduce(lambda a, b: a & b, [F.col(names[g]) for g in chosen[t]]) if chosen[t] else None
    test = _possible(query.tree, has)
    if test is None:
        return None
    found = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(*names))
    return found.groupBy("block").agg(*[F.max(F.col("gram") == g).alias(n) for g, n in names.items()]).where(test).select("block")


def ranges(blocks: DataFrame, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges that hold all the blocks: runs of neighbours, and if these are more than `most`, joined over the smallest gaps.

    Runs are found by a window over ranges of blocks; what goes to the driver is bounded: where runs are many, those of coarser
    blocks are taken instead."""
    from pyspark.sql import Window

    shift = 0
    while True:
        own = blocks.select(F.shiftright("block", shift).alias("b")).distinct()
        zone = F.shiftright("b", 16)
        order = Window.partitionBy("zone").orderBy("b")
        runs = own.withColumn("zone", zone).withColumn("run", F.col("b") - F.row_number().over(order)).groupBy("zone", "run").agg(F.min("b").alias("low"), F.max("b").alias("high"))
        found = sorted((r.low, r.high) for r in runs.select("low", "high").limit(20 * most + 1).collect())
        if len(found) <= 20 * most:
            break
        shift += 4
    while len(found) > most:  # join over the smallest gaps
        gaps = sorted(range(1, len(found)), key=lambda i: found[i][0] - found[i - 1][1])[: len(found) - most]
        drop, out = set(gaps), []
        for i, (low, high) in enumerate(found):
            if i in drop:
                out[-1] = (out[-1][0], high)
            else:
                out.append((low, high))
        found = out
    return [(low << shift, ((high + 1) << shift) - 1) for low, high in found]


def _any(tests: list[Column]) -> Column:
    """OR of many conditions as a balanced tree."""
    while len(tests) > 1:
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


def read(spark: SparkSession, path: str, query: Query) -> DataFrame:
    """The index rows that may match."""
    rows, found = spark.read.parquet(f"{path}/rows"), candidates(spark, path, query)
    if found is None:
        return rows
    kept = ranges(found)
    return rows.where(_any([F.col("block").between(a, b) for a, b in kept])) if kept else rows.where(F.lit(False))


def search(spark: SparkSession, path: str, query: Query, filters: Filters = Filters(), at: Fields = Fields()) -> DataFrame:
    """Index rows that match, with their score, as search.hits() gives them from a scan of all rows."""
    return read(spark, path, query).where(filters.condition(at)).where(condition(query, at)).withColumn("score", score(query, at)).drop("block")
