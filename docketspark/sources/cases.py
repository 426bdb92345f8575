"""Reading decisions and cases with fixed schemas, and side tables that may be missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..operators.normalize import PARAGRAPHS
from .arrays import read_array

METRIC = "struct<podmiot_w_sprawie:struct<present:boolean,text:string,items:array<string>>,przedmiot_sprawy:struct<present:boolean,text:string,items:array<string>,acts:array<struct<act:string,items:array<string>>>>,wzorce:struct<present:boolean,text:string,items:array<string>,acts:array<struct<act:string,items:array<string>>>>>"
RAW = (
    "ids struct<case_id:string,document_id:string>, case_signature string, decision_type string, topic string, proceeding_intro string, decision_date string, source_url string, "
    "download struct<href:string>, judges array<struct<name:string,role:string>>, table_of_contents array<struct<text:string,href:string>>, "
    "paragraphs array<struct<text:string,section:string,paragraph_number:string,paragraph_index:int>>, publication_entries array<struct<text:string>>, "
    f"metadata map<string,string>, case_metric {METRIC}"
)
CASES = (
    "case_id string, document_id string, case_signature string, decision_type string, decision_type_ipo_key string, decision_type_ipo_label string, decision_type_ipo_visible boolean, "
    "decision_date_raw string, decision_date_iso string, year int, topic string, proceeding_intro string, source_url string, download_url string, publication_entries array<struct<text:string>>, "
    "metadata map<string,string>, judges array<struct<name:string,role:string>>, judge_names array<string>, judge_count int, bench_size_key string, bench_size_label string, "
    "bench_size_ipo_key string, bench_size_ipo_label string, bench_size_ipo_visible boolean, is_full_bench boolean, "
    "table_of_contents array<struct<text:string,href:string,key:string>>, paragraph_count int, section_counts map<string,int>, normalization_version string, dataset_hash string, "
    f"dataset_generated_at string, paragraphs {PARAGRAPHS}"
)


def first_character(spark: SparkSession, path: str) -> str:
    """The first character of the data that is no white space, from the start of the first lines alone."""
    for row in spark.read.text(path).where("trim(value) <> ''").select(F.substring("value", 1, 1000)).limit(1).collect():
        return row[0].lstrip("\ufeff \t\r")[:1]
    return ""


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines, a JSON array, or one object over several lines, as the data's start tells. strict: a broken record fails the
    job; otherwise it is left out. Lines and arrays are split over tasks, one object cannot be."""
    start = first_character(spark, path)
    if start == "[":
        return read_array(spark, path, schema, strict)
    one_object = start == "{" and spark.read.text(path).where("trim(value) <> ''").limit(2).count() > 1 and not spark.read.text(path).where("trim(value) <> ''").first()[0].rstrip().endswith("}")
    reader = spark.read.schema(schema).option("multiLine", one_object)
    return reader.option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, RAW)


def load_cases(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return read_json(spark, path, CASES, strict)


def optional(spark: SparkSession, path: str | None, schema: str, fmt: str = "json") -> DataFrame:
    """A side table, empty if there is none."""
    if path:
        try:
            return spark.read.schema(schema).option("multiLine", fmt == "json").format(fmt).load(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], schema)


def bench_overrides(spark: SparkSession, path: str | None) -> DataFrame:
    """document_id, bench from `{"by_document_id": {id: bench}}`; unknown benches are left out."""
    rows = optional(spark, path, "by_document_id map<string,string>")
    return rows.select(F.explode("by_document_id").alias("document_id", "bench")).select(F.trim("document_id").alias("document_id"), "bench").where(F.col("bench").isin(*dims.BENCHES))


def of_dataset(rows: DataFrame, dataset_hash: str) -> DataFrame:
    """Rows of an artefact that belong to a dataset."""
    return rows.where(F.col("dataset_hash") == dataset_hash)


def files(spark: SparkSession, path: str, patterns: Sequence[str]) -> DataFrame:
    """path, length of all files that the patterns name; every pattern has to match one at least."""
    out = None
    for p in patterns:
        found = spark.read.format("binaryFile").option("pathGlobFilter", p).option("recursiveFileLookup", True).load(path).select("path", "length")
        if found.limit(1).count() == 0:
            raise FileNotFoundError(f"no file matches {p} below {path}")
        out = found if out is None else out.union(found)
    return out.distinct().orderBy("path")
