"""Lemma index: forms, postings and positions as tables, and searches over them as joins.

A lemmatizer is a table of (form, lemma) or a function over distinct forms; a form without an entry is its own lemma. The
index keeps stable keys (document_id, paragraph_id), never row numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import fold_plain, lemma_tokens
from ..sources.shared import stored
from .query import Query, Text

KEY = ["document_id", "paragraph_id"]
#: Buckets at most when terms are numbered: their cut points are part of the plan.
MOST_BUCKETS = 256


def occurrences(paragraphs: DataFrame, text: str = "text", key: Sequence[str] = KEY, spaced: bool = False) -> DataFrame:
    """key, pos, form: every token of every paragraph. spaced: texts have single spaces already."""
    return paragraphs.select(*key, F.posexplode(lemma_tokens(text, spaced)).alias("pos", "form"))


def forms(found: DataFrame, dictionary: DataFrame | None = None, lemmatize: Callable[[str], Sequence[str]] | None = None) -> DataFrame:
    """form, lemma for the distinct forms of the corpus; each form is looked up once."""
    own = found.select("form").distinct()
    if lemmatize is not None:

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([(f, x) for f in b["form"] for x in sorted({fold_plain(y.split(":")[0]) for y in lemmatize(f)} - {""}) or [f]], columns=["form", "lemma"])

        return own.mapInPandas(work, "form string, lemma string").distinct()
    if dictionary is None:
        return own.select("form", F.col("form").alias("lemma"))
    return own.join(dictionary.select("form", "lemma").distinct(), "form", "left").select("form", F.coalesce("lemma", "form").alias("lemma"))


def positions(found: DataFrame, lemmas: DataFrame) -> DataFrame:
    """lemma, key, pos. A place has one form, and forms() gives each pair of form and lemma once, so rows are distinct."""
    return found.join(lemmas, "form").drop("form")


def postings(found: DataFrame) -> DataFrame:
    """lemma, key, distinct: from positions."""
    return found.drop("pos").distinct()


def packed(found: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """lemma, key, positions: sorted arrays of places, for export."""
    return found.groupBy("lemma", *key).agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def packed_rows(paragraphs: DataFrame, lemma_of: Callable[[Column], Column], text: str = "text", key: Sequence[str] = KEY, spaced: bool = False) -> DataFrame:
    """lemma, key, positions: packed() of all tokens, made within a key's row, so that texts are shuffled instead of places.

    lemma_of: the dictionary as an expression over a form. Texts that share a key are gathered first."""
    rows = paragraphs.groupBy(*key).agg(F.collect_list(text).alias("texts"))
    places = lambda t: F.transform(lemma_tokens(t, spaced), lambda f, i: F.struct(lemma_of(f).alias("lemma"), i.alias("pos")))
    own = F.when(F.size("texts") == 1, places(F.col("texts")[0])).otherwise(F.array_distinct(F.flatten(F.transform("texts", places))))
    # Each column is used more than once behind, so Spark makes it once a row.
    rows = rows.select(*key, F.sort_array(own).alias("own"))
    new = F.transform("own", lambda x, i: F.when((i == 0) | ~x["lemma"].eqNullSafe(F.col("own")[F.greatest(i - 1, F.lit(0))]["lemma"]), i))
    rows = rows.select(*key, "own", F.array_compact(new).alias("at"))
    runs = F.transform("at", lambda a, k: F.struct(F.col("own")[a]["lemma"].alias("lemma"), F.slice("own", a + 1, F.coalesce(F.get("at", k + 1), F.size("own")) - a)["pos"].alias("positions")))
    return rows.select(*key, F.inline(runs)).select("lemma", *key, "positions")


def lemmas_of(paragraphs: DataFrame, lemma_of: Callable[[Column], Column], text: str = "text", key: Sequence[str] = KEY, spaced: bool = False) -> DataFrame:
    """lemma, key: the distinct lemmas of each paragraph, found within its row; rows repeat only where keys do."""
    return paragraphs.select(F.explode(F.array_distinct(F.transform(lemma_tokens(text, spaced), lemma_of))).alias("lemma"), *key)


def of_token(found: DataFrame, lemmas: DataFrame, token: str) -> DataFrame:
    """key, pos where any lemma of the token stands; a token that no form has is looked up as a lemma.

    found: positions (lemma), or occurrences (form). Of occurrences only those of the lemmas' forms are kept, where the tokens
    are made, so no other token is shuffled or meets the dictionary."""
    own = lemmas.where(F.col("form") == token).select("lemma").distinct()
    itself = own.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(token).alias("lemma"))
    wanted = F.broadcast(own.union(itself))  # a form has a few lemmas
    if "form" in found.columns:
        wanted_forms = F.broadcast(lemmas.join(wanted, "lemma").select("form").distinct())  # a lemma has a few forms
        return found.join(wanted_forms, "form", "left_semi").drop("form")
    return found.join(wanted, "lemma").drop("lemma").distinct()


def phrase(found: DataFrame, lemmas: DataFrame, tokens: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """Keys of paragraphs where the tokens' lemmas follow each other: the k-th at the first's place plus k."""
    starts = [of_token(found, lemmas, t).select(*key, (F.col("pos") - k).alias("start")) for k, t in enumerate(tokens)]
    return reduce(lambda a, b: a.join(b, [*key, "start"]), starts).select(*key).distinct()


def all_of(found: DataFrame, lemmas: DataFrame, tokens: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """Keys of paragraphs that have every token."""
    return reduce(lambda a, b: a.join(b, list(key), "left_semi"), [of_token(found, lemmas, t).select(*key).distinct() for t in tokens])


def words_of(text: str) -> list[str]:
    """A query text's tokens, as the index has them."""
    import re

    from ..functions.text import legal_plain

    return [w for w in re.split(r"[^\w-]+", legal_plain(text)) if w]


def operand_keys(found: DataFrame, lemmas: DataFrame, t: Text, key: Sequence[str] = KEY) -> DataFrame:
    words = words_of(t.raw)
    return phrase(found, lemmas, words, key) if t.quoted and len(words) > 1 else all_of(found, lemmas, words, key)


def search(index: DataFrame, found: DataFrame, lemmas: DataFrame, query: Query, key: Sequence[str] = KEY) -> DataFrame:
    """Index rows that the query matches with its texts read as lemmas. Each distinct operand is looked up once and joined as
    a flag; the boolean tree stays one Column."""
    from .query import condition, score

    flags, rows = {}, index
    for i, t in enumerate(dict.fromkeys(query.texts)):
        flags[t] = f"operand_{i}"
        rows = rows.join(operand_keys(found, lemmas, t, key).withColumn(flags[t], F.lit(True)), list(key), "left")
    out = rows.where(condition(query, text=lambda t: F.coalesce(F.col(flags[t]), F.lit(False))))
    return out.withColumn("score", score(query)).drop(*flags.values())


def search_or_plain(index: DataFrame, artefact: tuple[DataFrame, DataFrame] | None, query: Query, key: Sequence[str] = KEY) -> DataFrame:
    """Search by lemma where there is an index, else by text."""
    from .search import hits

    return hits(index, query) if artefact is None else search(index, *artefact, query, key)


def highlights(rows: DataFrame, found: DataFrame, lemmas: DataFrame, query: Query, text: str = "text", key: Sequence[str] = KEY) -> DataFrame:
    """key, start, end of the words that a quoted query's lemmas match in a row.

    Word spans come from the text as written, places from the index; both count the same tokens, so they join on the place."""
    from .search import word_spans

    out = None
    for t in query.texts:
        words = words_of(t.raw)
        if not t.quoted or not words:
            continue
        starts = [of_token(found, lemmas, w).select(*key, (F.col("pos") - k).alias("start_pos")) for k, w in enumerate(words)]
        at = reduce(lambda a, b: a.join(b, [*key, "start_pos"]), starts).distinct()
        places = at.select(*key, F.explode(F.sequence(F.col("start_pos"), F.col("start_pos") + len(words) - 1)).alias("pos"))
        out = places if out is None else out.union(places)
    if out is None:
        return rows.select(*key, F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    spans = word_spans(rows, text, list(key))
    numbered = spans.withColumn("pos", (F.row_number().over(Window.partitionBy(*key).orderBy("start")) - 1).cast("int"))
    return numbered.join(out.distinct(), [*key, "pos"]).select(*key, "start", "end")


def shards(terms: DataFrame, term: str = "term", size: int = dims.SHARD_TERMS) -> DataFrame:
    """shard, from, to, n: distinct sorted terms in runs of a fixed number.

    Terms are dealt into buckets between cut points that a sample gives once, so whoever computes a term's bucket finds the
    same; its number is its number in the bucket plus the buckets before. No task sees all terms, and the driver gets a sample
    of bounded size and one number for each bucket."""
    own = stored(terms.select(F.col(term).alias("term")).distinct(), "terms")
    cuts = cut_points(own, min(MOST_BUCKETS, max(1, int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("term"))) if cuts else F.lit(0)
    dealt = own.withColumn("part", bucket)
    counts, before = {}, 0
    for part, n in sorted(map(tuple, dealt.groupBy("part").count().collect())):
        counts[part], before = before, before + n
    if not counts:
        return terms.select(F.lit(0).alias("shard"), F.lit("").alias("from"), F.lit("").alias("to"), F.lit(0).cast("long").alias("n")).limit(0)
    base = F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("part"))
    number = base + F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1
    return dealt.withColumn("shard", F.floor(number / size).cast("int")).groupBy("shard").agg(F.min("term").alias("from"), F.max("term").alias("to"), F.count(F.lit(1)).alias("n"))


def cut_points(terms: DataFrame, n: int, each: int = 32) -> list[str]:
    """At most n - 1 ascending terms that cut distinct terms into about equal parts: every 32nd of a sample by hash."""
    if n < 2:
        return []
    found = sorted(r.term for r in terms.where("term is not null").orderBy(F.xxhash64("term"), "term").limit(n * each).collect())
    return [found[len(found) * i // n] for i in range(1, n)] if len(found) >= n else []


def write_index(paragraphs: DataFrame, path: str, dataset_hash: str, dictionary: DataFrame | None = None, lemmatize: Callable[[str], Sequence[str]] | None = None) -> None:
    """forms, positions and postings below path, sorted by lemma so that Parquet statistics prune lookups; a manifest row."""
    found = occurrences(paragraphs)
    lemmas = forms(found, dictionary, lemmatize)
    put = lambda df, name, by: df.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").parquet(f"{path}/{name}")
    put(lemmas, "forms", "form")
    put(positions(found, lemmas), "positions", "lemma")
    spark = paragraphs.sparkSession
    put(postings(spark.read.parquet(f"{path}/positions")), "postings", "lemma")
    kept = spark.read.parquet(f"{path}/forms")
    head = kept.agg(F.countDistinct("form").alias("forms"), F.countDistinct("lemma").alias("lemmas"))
    head.select(F.lit("lemma-index-1").alias("schema_version"), F.lit(dataset_hash).alias("dataset_hash"), "forms", "lemmas", F.current_timestamp().alias("built_at")).write.mode("overwrite").json(f"{path}/manifest")


def read_index(spark, path: str, dataset_hash: str) -> tuple[DataFrame, DataFrame] | None:
    """(positions, forms) if the index belongs to this dataset, else None: callers then search without lemmas."""
    manifest = spark.read.json(f"{path}/manifest").where(F.col("dataset_hash") == dataset_hash)
    if manifest.limit(1).count() == 0:
        return None
    return spark.read.parquet(f"{path}/positions"), spark.read.parquet(f"{path}/forms")
