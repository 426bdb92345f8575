"""Corpus statistics: rankings, pairs, matrices, bigrams, key figures. Each is one aggregation that Spark combines map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import adjacent, fold_plain, surface_tokens


def ranking(rows: DataFrame, key: Column | str, n: int | None = None, name: str = "label") -> DataFrame:
    """label, n: how often each value occurs, most frequent first, then by value; nulls and empty values left out."""
    own = rows.select((F.col(key) if isinstance(key, str) else key).alias(name)).where(F.coalesce(F.col(name).cast("string"), F.lit("")) != "")
    out = own.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.col("n").desc(), name).limit(n) if n else out


def with_all(counts: DataFrame, values: Sequence[str], name: str = "label") -> DataFrame:
    """The counts of a fixed list of values, 0 for those that do not occur."""
    spark = counts.sparkSession
    return spark.createDataFrame([(v,) for v in values], f"{name} string").join(counts, name, "left").select(name, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def members(rows: DataFrame, case: str, array: Column) -> DataFrame:
    """case, member: distinct members of an array, unfolded."""
    return rows.select(case, F.explode(F.array_distinct(array)).alias("member")).where("member is not null and member <> ''")


def pairs(of: DataFrame, case: str, member: str = "member") -> DataFrame:
    """a, b, n: in how many cases two members (a < b) stand together.

    A case's members are gathered once and its pairs made within the row, so no join multiplies rows between tasks; a bench has
    a few members at most."""
    rows = of.groupBy(case).agg(F.sort_array(F.collect_set(member)).alias("m"))
    own = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice(F.col("m"), i + 2, F.greatest(F.size("m"), F.lit(1))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return rows.select(F.inline(own)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(of: DataFrame, case: str, n: int = 14, member: str = "member") -> DataFrame:
    """a, b, n for the n most frequent members: both orders, the diagonal their own counts, 0 where two never meet."""
    own = of.groupBy(member).agg(F.countDistinct(case).alias("n"))
    top = own.orderBy(F.col("n").desc(), member).limit(n)
    a, b = top.select(F.col(member).alias("a"), F.col("n").alias("own")), top.select(F.col(member).alias("b"))
    grid = a.crossJoin(F.broadcast(b))  # n by n rows
    kept = of.join(F.broadcast(top.select(member)), member)
    found = pairs(kept, case, member)
    both = found.union(found.select("b", "a", "n"))
    return grid.join(both, ["a", "b"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), F.col("own")).otherwise(F.coalesce("n", F.lit(0).cast("long"))).alias("n"))


def bigrams(rows: DataFrame, text: Column | str, order: Sequence[str], spaced: bool = False) -> DataFrame:
    """key, label, n: adjacent words of filtered tokens within a paragraph, aliases merged. The label is the last one in
    corpus order. spaced: texts have single spaces already."""
    toks = rows.select(*order, surface_tokens(text, dims.BIGRAM_STOPWORDS, spaced).alias("toks"))
    made = toks.select(*order, F.posexplode(adjacent(F.col("toks"))).alias("place", "p"))
    key, label = F.concat_ws(" ", "p.a.norm", "p.b.norm"), F.concat_ws(" ", "p.a.token", "p.b.token")
    alias = F.create_map(*[F.lit(x) for k, v in dims.PHRASE_ALIASES.items() for x in (fold_plain(k, True), v)])
    known = sorted({fold_plain(k, True) for k in dims.PHRASE_ALIASES})  # one look, where the map compares entry by entry
    canon = F.create_map(*[F.lit(x) for v in set(dims.PHRASE_ALIASES.values()) for x in (v, fold_plain(v, True))])
    named = made.select(*order, "place", key.alias("raw"), label.alias("own")).withColumn("alias", F.when(F.col("raw").isin(*known), F.element_at(alias, F.col("raw"))))
    named = named.select(*order, "place", F.coalesce(F.element_at(canon, F.col("alias")), F.col("raw")).alias("key"), F.coalesce("alias", "own").alias("label"))
    # One aggregation: places differ, so the largest row of place and label is that of the last place.
    own = named.groupBy("key").agg(F.max(F.struct(*order, "place", "label")).alias("last"), F.count(F.lit(1)).alias("n"))
    return own.select("key", F.col("last.label").alias("label"), "n")


def split_noise(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bigrams that say something, and those of the noise list."""
    noise = F.col("key").isin(*sorted({fold_plain(p, True) for p in dims.NOISE_PHRASES}))
    return counts.where(~noise), counts.where(noise)


def summary(cases: DataFrame, year: str, paragraphs: str) -> DataFrame:
    """Key figures of a corpus in one row."""
    return cases.agg(
        F.count(F.lit(1)).alias("total_cases"), F.count(year).alias("dated_cases"), F.count_if(F.col(year).isNull()).alias("undated_cases"), F.sum(paragraphs).alias("total_paragraphs"),
        F.round(F.avg(paragraphs), 2).alias("avg_paragraphs"), F.min(year).alias("min_year"), F.max(year).alias("max_year"),
    )


def unknown_share(paragraphs: DataFrame, key: str = "section_key") -> DataFrame:
    return paragraphs.agg(F.round(F.avg(F.when(F.col(key) == dims.UNKNOWN, 1.0).otherwise(0.0)), 6).alias("unknown_share"))


def section_counts(paragraphs: DataFrame, case: str, key: str = "section_key") -> DataFrame:
    """case, section_counts: a map from section to its number of paragraphs."""
    n = paragraphs.groupBy(case, key).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.groupBy(case).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("section_counts"))


def viewer_sections(paragraphs: DataFrame, case: str, place: str, key: str = "section_key") -> DataFrame:
    """case, section, first, n, first and last paragraph: sections in the order of their first appearance."""
    return paragraphs.groupBy(case, key).agg(F.min(place).alias("first_place"), F.count(F.lit(1)).alias("n"), F.min_by("paragraph_id", place).alias("first_id"), F.max_by("paragraph_id", place).alias("last_id"))


def shares(counts: DataFrame, n: int = 10) -> DataFrame:
    """The n largest of label, n with their share of the total and their bar (percent of the largest, 6 at least)."""
    total = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    top = counts.orderBy(F.col("n").desc(), "label").limit(n).crossJoin(F.broadcast(total))  # one row
    return top.select("label", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("share"), F.greatest(F.lit(6.0), F.round(100 * F.col("n") / F.col("most"), 1)).alias("bar"))


def top_of_each(counts: DataFrame, by: str, n: int, label: str = "label") -> DataFrame:
    """The n largest labels within each group."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("n").desc(), label))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def facets(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """facet, value, n over several columns with one pass (grouping sets)."""
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        here = F.grouping(c) == 0
        which, value = F.when(here, F.lit(c)).otherwise(which), F.when(here, F.col(c).cast("string")).otherwise(value)
    out = rows.groupingSets([[c] for c in columns], *columns).agg(which.alias("facet"), value.alias("value"), F.count(F.lit(1)).alias("n"))
    return out.select("facet", "value", "n")


def stats_document(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of JSON: each table as an array of its rows in its own order. For rankings, which are cut to a fixed length."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.to_json(F.collect_list(F.struct(*t.columns))).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out.select(F.to_json(F.struct(*tables)).alias("document"))
