"""SimHash document fingerprints, and search within a Hamming radius through permuted block tables.

Terms are a lower-cased text's word pairs (and its last word alone). A term votes with a weight from 1 to 4 that grows with
its length, as long terms are the rarer ones; for each of 64 hash bits the votes of terms with the bit set count for it, the
others against it. Likeness of two fingerprints is the share of equal bits.

near(): with radius r the 64 bits are cut into r + 2 blocks. Two fingerprints within r bits agree in two blocks at least,
so each choice of two blocks is a table (the bits permuted so that those blocks come first), and equal keys in some table are
the candidates; the exact distance decides. All distinct fingerprints are in the tables, without caps.

Everything here is DataFrame functions. Null texts count as empty; texts without words have the fingerprint 0. Rows with
equal ids are fingerprinted each on its own, in the order of their texts. A null id counts as larger than all others. An
empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, partitions, range_bounds, text_of
from .votes import block_keys, fingerprint, lane_sums, words_of

LAST = (1 << 63) - 1


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, next_text by ascending id (the first follows the last), bucket, place, ghost.

    Rows are dealt by ranges of the id, and the following row is found within the range. The first row of each range is also
    placed, as a ghost, at the end of the range before; callers drop ghosts after use."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(LAST)))
    bounds = range_bounds(rows, "key", 4 * partitions(docs.sparkSession))
    rows = rows.withColumn("bucket", bucket_of(F.col("key"), bounds))
    firsts = dict(map(tuple, rows.groupBy("bucket").agg(F.min("key")).collect()))  # one number for each range
    filled = sorted(firsts)
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    first, before = [LAST] * (len(bounds) + 1), [-1] * (len(bounds) + 1)
    for i, b in enumerate(filled):
        first[b], before[b] = firsts[b], filled[i - 1]
    own = F.struct(F.col("bucket"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.get(longs(before), F.col("bucket")).cast("int").alias("bucket"), F.lit(1).alias("ghost"))
    places = F.when(F.get(longs(first), F.col("bucket")) == F.col("key"), F.array(own, ghost)).otherwise(F.array(own))
    rows = rows.select("doc_id", "key", "text", F.inline(places))
    order = Window.partitionBy("bucket").orderBy("ghost", "key", "text")
    return rows.select("doc_id", "text", F.lead("text").over(order).alias("next_text"), "bucket", F.row_number().over(order).alias("place"), "ghost")


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as much of the following one's start."""
    n = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - n), F.substring(F.coalesce(following, F.lit("")), F.lit(1), n))


def pair_fingerprints(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, fp_a, fp_b: the fingerprints of two text columns. keys name one row each."""
    words = rows.select(*keys, words_of(F.lower(a)).alias("wa"), words_of(F.lower(b)).alias("wb"))
    words = words.withColumn("na", F.size("wa")).withColumn("n", F.size("wa") + F.size("wb"))
    i, na = F.col("i"), F.col("na")
    terms = words.select(*keys, "wa", "wb", "na", F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))).alias("i"))
    term = F.when(i < na, F.concat_ws(" ", F.get("wa", i), F.get("wa", i + 1))).otherwise(F.concat_ws(" ", F.get("wb", i - na), F.get("wb", i - na + 1)))
    terms = terms.select(*keys, F.coalesce(i < na, F.lit(True)).alias("first"), F.when(i.isNotNull(), term).alias("term"))
    weight = F.least(F.lit(4), 1 + F.floor(F.length("term") / 6)).cast("long")
    votes = terms.select(*keys, "first", F.xxhash64("term").alias("h"), F.when(F.col("term").isNotNull(), weight).otherwise(F.lit(0).cast("long")).alias("w"))
    sums = votes.groupBy(*keys, "first").agg(*lane_sums(F.col("h"), F.col("w")), F.sum("w").alias("total"))
    prints = sums.select(*keys, "first", fingerprint(F.col("total")).alias("fp"))
    side = lambda s: F.coalesce(F.max(F.when(F.col("first") == s, F.col("fp"))), F.lit(0).cast("long"))
    return prints.groupBy(*keys).agg(side(True).alias("fp_a"), side(False).alias("fp_b"))


def fingerprint_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp (longs): each document's fingerprint, that of its edited text
    and that of the following document. Texts are shuffled once; votes, fingerprints and neighbours stay in that dealing."""
    rows = with_next(docs, id_column, text_column).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("bucket", "place", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    keys = ["bucket", "place", "ghost", "doc_id", "n_chars", "edited_sha256"]
    prints = pair_fingerprints(rows, keys, "text", "edited")
    after = F.lead("fp_a").over(Window.partitionBy("bucket").orderBy("place"))
    out = prints.select(*keys, F.col("fp_a").alias("fp"), F.col("fp_b").alias("edited_fp"), after.alias("next_fp"))
    return out.where("ghost = 0").drop("bucket", "place", "ghost")


def near(queries: DataFrame, index: DataFrame, radius: int = 3) -> DataFrame:
    """query_fp, fp, distance: all distinct fingerprints of `index` (column fp) within the radius of each distinct one of
    `queries` (column fp), itself included."""
    tables = lambda df, name: df.select(F.col("fp").alias(name)).where("fp is not null").distinct().select(name, F.inline(block_keys(F.col(name), radius + 2, 2)))
    pairs = tables(queries, "query_fp").join(tables(index, "fp"), ["table", "bits"])
    distance = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp")))
    return pairs.where(distance <= radius).select("query_fp", "fp", distance.alias("distance")).distinct()


def count_near(prints: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """query_fp, n_near: how many documents lie within the radius, for the fingerprints of documents whose id is a multiple
    of `every` (the search's query set), against all documents."""
    held = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    found = near(prints.where(F.col("doc_id") % every == 0), held, radius)
    return found.join(held, "fp").groupBy("query_fp").agg(F.sum("n").alias("n_near"))
