"""Registering a query over the driver's tables together with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import legal, normalize_space

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str) -> Callable:
    """Registers a function by its name. ctes: common tables that the SQL reads."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_ns(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, chr(160), ' '), '\\s+', ' ', 'g'))"


def sql_fold(x: str) -> str:
    return f"strip_accents(lower({sql_ns(x)}))"


def sql_build(x: str) -> str:
    return f"replace({sql_fold(x)}, 'ł', 'l')"


def sql_legal(x: str) -> str:
    joined = f"regexp_replace({sql_fold(x)}, '(^|[^a-z0-9_])art\\.?\\s*([0-9]+[a-z]?)', '\\1art\\2', 'g')"
    return f"trim(regexp_replace(regexp_replace({joined}, '\\s*§\\s*', ' § ', 'g'), '\\s+', ' ', 'g'))"


def sql_tokens(folded: str, stopwords=(), least: int = 3) -> str:
    stop = f" AND NOT list_contains({sql_list(stopwords)}, x)" if stopwords else ""
    return f"list_filter(string_split_regex({folded}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= {least} AND NOT regexp_matches(x, '^[0-9]+$'){stop})"


KEYS = list(dims.SECTIONS)

#: Lines of documents stand for paragraphs, their number in turn for the section, the document's id for a year and signature.
LINES = f"""lines AS (
    SELECT doc_id, lang, source, pos, {sql_ns('raw')} AS text, 'd' || doc_id || '-' || pos AS paragraph_id, {sql_list(KEYS)}[((pos - 1) % 11) + 1] AS section_key,
        1990 + doc_id % 30 AS year, 'k ' || (doc_id % 50) || '/' || (doc_id % 7) AS signature
    FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)
    WHERE {sql_ns('raw')} <> '')"""
INDEX = LINES + f", idx AS (SELECT *, {sql_legal('text')} AS t FROM lines)"


def section_at(position: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KEYS)), ((position - 1) % 11 + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, pos, text, paragraph_id, section_key, year, signature of all lines that are not empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    # A text is empty where its line has white space only: seen at the line's first letter, without making the text twice.
    rows = docs.where(F.col("raw").rlike(r"(?U)\S")).select("doc_id", "lang", "source", (F.col("i") + 1).cast("long").alias("pos"), normalize_space("raw").alias("text"))
    return rows.select("*", F.concat(F.lit("d"), "doc_id", F.lit("-"), "pos").alias("paragraph_id"), section_at(F.col("pos")).alias("section_key"), (1990 + F.col("doc_id") % 30).alias("year"), F.concat(F.lit("k "), F.col("doc_id") % 50, F.lit("/"), F.col("doc_id") % 7).alias("signature"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with the columns that queries search."""
    return lines(spark, sf_dir).withColumns({"text_legal": legal("text", spaced=True), "case_signature_norm": F.col("signature"), "judge_norm": F.array("source"), "decision_type_norm": F.col("lang"), "topic_norm": F.col("lang"), "document_id": F.col("doc_id"), "paragraph_index": F.col("pos")})


def sql_case(column: str, values: dict, default: object) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in values.items()) + f" ELSE {lit(default)} END"


def sql_count(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, '{term}', ''))) / {len(term)})::INT"
