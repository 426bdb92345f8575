"""Search over a paragraph index: match, score, group by case, page, snippet, context, highlight.

An index has a row for each paragraph with the folded columns of its case (see query.Fields). A search is one scan with a
filter, then a shuffle of the hits by case; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.classify import heading_like
from ..functions.text import fold_search, legal, normalize_space, snippet
from .query import Fields, Filters, Query, SearchRequest, condition, parse, score


def paragraph_index(cases: DataFrame) -> DataFrame:
    """The index of normalized cases, paragraphs unfolded and everything folded once."""
    folded = lambda c: fold_search(F.col(c))
    case = [
        "document_id", "case_signature", "decision_date_iso", "year", "decision_type_ipo_key", "bench_size_ipo_key", folded("case_signature").alias("case_signature_norm"),
        folded("decision_type").alias("decision_type_norm"), folded("topic").alias("topic_norm"), F.transform("judge_names", lambda j: fold_search(j)).alias("judge_norm"),
    ]
    rows = cases.select(*case, F.posexplode("paragraphs").alias("place", "p"))
    return rows.select(*[c for c in rows.columns if c != "p"], *[F.col(f"p.{k}").alias(k) for k in ("paragraph_id", "paragraph_index", "paragraph_number", "section_key", "section_label", "text")]).withColumn("text_legal", legal("text"))


def hits(index: DataFrame, query: Query, filters: Filters = Filters(), at: Fields = Fields()) -> DataFrame:
    """Index rows that match, with their score. Facets come first, so that they are pushed to the scan."""
    return index.where(filters.condition(at)).where(condition(query, at)).withColumn("score", score(query, at))


def _case_order(case_keys: Sequence[str]) -> list[Column]:
    return [F.col("top_score").desc(), *[F.col(k).desc() if k.startswith("decision_date") else F.col(k) for k in case_keys]]


def grouped(found: DataFrame, case: str = "document_id", order: Sequence[str] = ("paragraph_index", "paragraph_id")) -> DataFrame:
    """Hits with hit_count, top_score and their rank within the case (score, then place)."""
    own = Window.partitionBy(case)
    rank = F.row_number().over(own.orderBy(F.col("score").desc(), *[F.col(c) for c in order]))
    return found.withColumn("hit_count", F.count(F.lit(1)).over(own)).withColumn("top_score", F.max("score").over(own)).withColumn("hit_rank", rank)


def cases_of(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each case with hit_count and top_score; pre-aggregated before the shuffle."""
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("hit_count"), F.max("score").alias("top_score"))


def page(groups: DataFrame, order: Sequence[Column], number: int = 1, size: int = dims.PAGE_SIZE) -> DataFrame:
    """Rows of one page, from 1. Sorted as a whole only as far as the page needs."""
    return groups.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def search(index: DataFrame, request: SearchRequest, at: Fields = Fields()) -> DataFrame:
    """One page of cases with hit_count and top_score; without a query and section facet the corpus in its own order."""
    query = parse(request.query)
    keys = ["document_id", "case_signature", "decision_date_iso"]
    if query.tree is None and not request.filters.sections:
        browsed = index.where(request.filters.condition(at)).select(*keys).distinct().withColumns({"hit_count": F.lit(0), "top_score": F.lit(0.0)})
        return page(browsed, [F.col("decision_date_iso").desc(), F.col("case_signature")], request.page)
    groups = cases_of(hits(index, query, request.filters, at), keys)
    return page(groups, [F.col("top_score").desc(), F.col("decision_date_iso").desc(), F.col("case_signature")], request.page)


def with_snippet(found: DataFrame, query: Query, text: str = "text", width: int = dims.SNIPPET, lead: int = dims.SNIPPET_LEAD) -> DataFrame:
    """Hits with a snippet. The text's two forms are columns of their own, so each is made once."""
    staged = found.withColumns({"snippet_source": normalize_space(text), "snippet_form": F.col("text_legal") if "text_legal" in found.columns else legal(text)})
    return staged.withColumn("snippet", snippet(F.col("snippet_source"), F.col("snippet_form"), query.terms(), width, lead)).drop("snippet_source", "snippet_form")


def context(rows: DataFrame, case: str, place: str, columns: Sequence[str]) -> DataFrame:
    """The columns of the paragraph before and after, as prev_ and next_."""
    own = Window.partitionBy(case).orderBy(place)
    return rows.withColumns({f"{side}_{c}": f(c).over(own) for side, f in (("prev", F.lag), ("next", F.lead)) for c in columns})


def merge_headings(ranked: DataFrame, case: str = "document_id", rank: str = "hit_rank") -> DataFrame:
    """Hits in ranked order; a heading takes up the next hit if that is the next paragraph of its section and no heading.

    Only one of two neighbours can be a heading of the other, so pairs never chain and one look ahead is enough."""
    own = Window.partitionBy(case).orderBy(rank)
    after = lambda c: F.lead(c).over(own)
    marked = ranked.withColumn("is_heading", heading_like("text"))
    joins = marked.is_heading & ~after("is_heading") & (after("section_key") == F.col("section_key")) & (after("paragraph_index") == F.col("paragraph_index") + 1)
    marked = marked.withColumn("joins", F.coalesce(joins, F.lit(False)))
    marked = marked.withColumn("merged_heading", F.when(F.lag("joins").over(own), normalize_space(F.lag("text").over(own))))
    return marked.where(~F.col("joins")).drop("joins", "is_heading")


def layer(groups: DataFrame, blob: Column, terms: Sequence[str]) -> DataFrame:
    """A second filter over results: cases whose folded text holds all terms."""
    test = F.lit(True)
    for t in terms:
        test &= blob.contains(t)
    return groups.where(test)


def coverage(rows: DataFrame, matching: Column) -> DataFrame:
    """Matching and all rows, and the percentage."""
    out = rows.agg(F.count_if(matching).alias("matching"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("percent", F.when(F.col("total") > 0, F.round(100 * F.col("matching") / F.col("total"), 1)).otherwise(0.0))


def sidebar_terms(rows: DataFrame, text: str, query: Query, n: int = dims.SIDEBAR_TERMS) -> DataFrame:
    """The most frequent words of at least four letters that are neither stop words nor in the query."""
    own = sorted({w for t in query.texts for w in t.norm.split()})
    words = F.explode(F.filter(F.split(fold_search(text), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) >= 4) & ~t.isin(*dims.SIDEBAR_STOPWORDS, *own)))
    return rows.select(words.alias("term")).groupBy("term").count().orderBy(F.col("count").desc(), "term").limit(n)


def issues(paragraphs: DataFrame, query: Query, n: int = dims.MATRIX_WORDS) -> list[str]:
    """The issues of an argument matrix: the query's texts, or without any the most frequent words (column text)."""
    if query.texts:
        return list(dict.fromkeys(t.raw for t in query.texts))[: dims.MATRIX_ISSUES]
    words = F.explode(F.filter(F.split(fold_search("text"), r"[^\p{L}\p{N}_-]+"), lambda t: (F.length(t) >= 4) & ~t.isin(*dims.SIDEBAR_STOPWORDS)))
    return [r.term for r in paragraphs.select(words.alias("term")).groupBy("term").count().orderBy(F.col("count").desc(), "term").limit(n).collect()]


def recent(queries: DataFrame, query: str = "query", at: str = "ts", n: int = dims.HISTORY_ENTRIES) -> DataFrame:
    """query, last_at: the queries used last, each once; empty ones are left out."""
    rows = queries.select(normalize_space(query).alias("query"), F.col(at).alias("at")).where("query <> ''")
    return rows.groupBy("query").agg(F.max("at").alias("last_at")).orderBy(F.col("last_at").desc(), "query").limit(n)


def chronology(rows: DataFrame, by: str, date: str, key: str) -> DataFrame:
    """rows with their place by date within each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(date, key)))


def argument_matrix(paragraphs: DataFrame, issues: Sequence[str], case: str, label: str, place: str, cell: int = 4) -> DataFrame:
    """issue, case, cell: the first labels of a case's paragraphs that hold the issue. Issues are a handful of words, given on
    the driver."""
    listed = F.explode(F.filter(F.array(*map(F.lit, issues)), lambda i: F.col("text_fold").contains(i))).alias("issue")
    found = paragraphs.select(case, label, place, listed)
    rank = F.row_number().over(Window.partitionBy("issue", case).orderBy(place))
    first = found.withColumn("rank", rank).where(F.col("rank") <= cell)
    ordered = F.array_sort(F.collect_list(F.struct("rank", label)))
    return first.groupBy("issue", case).agg(F.concat_ws(" | ", F.transform(ordered, lambda x: x[label])).alias("cell"))


def _ranges(text: pd.Series, patterns: pd.Series) -> pd.Series:
    return pd.Series([highlight_ranges(t, list(p)) for t, p in zip(text, patterns)])


def highlight_ranges(text: str | None, patterns: Sequence[str]) -> list[dict[str, int]]:
    """Places of folded patterns in the text as written; a single word is widened to the whole ASCII word; overlaps merged."""
    import unicodedata

    folded, place = [], []
    for i, c in enumerate((text or "").replace(" ", " ")):
        for x in unicodedata.normalize("NFD", c.lower()):
            if not "̀" <= x <= "ͯ":
                folded.append(x)
                place.append(i)
    norm, found = "".join(folded), []
    inside = lambda k: norm[k].isascii() and (norm[k].isdigit() or norm[k].islower())
    for p in sorted({p for p in patterns if len(p) >= 3}, key=len, reverse=True):
        at = norm.find(p)
        while at >= 0:
            a, b = at, at + len(p)
            if " " not in p:
                while a and inside(a - 1):
                    a -= 1
                while b < len(norm) and inside(b):
                    b += 1
            found.append((place[a], place[b - 1] + 1))
            at = norm.find(p, at + len(p))
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def with_highlights(rows: DataFrame, query: Query, text: str = "text") -> DataFrame:
    """A column of (start, end) ranges to mark. Offsets need a walk through the text, so this is a pandas UDF."""
    patterns = F.array(*[F.lit(p) for t in query.texts for p in dict.fromkeys((t.norm, t.legal))]).cast("array<string>")
    return rows.withColumn("highlights", F.pandas_udf(_ranges, "array<struct<start:int,end:int>>")(F.col(text), patterns))


def marked(text: Column, ranges: Column) -> Column:
    """The text with <mark> around the ranges."""
    step = lambda acc, r: F.struct(r["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, r["start"] - acc["at"]), F.lit("<mark>"), F.substring(text, r["start"] + 1, r["end"] - r["start"]), F.lit("</mark>")).alias("out"))
    return F.aggregate(ranges, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def word_spans(rows: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """keep columns, token, start, end of every word as written."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        word = re.compile(r"[\w-]+")
        for b in batches:
            yield pd.DataFrame([(*row[:-1], m[0], m.start(), m.end()) for row in b.itertuples(index=False, name=None) for m in word.finditer(row[-1] or "")], columns=[*keep, "token", "start", "end"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select(*keep, text).mapInPandas(work, f"{kinds}, token string, start int, end int")
