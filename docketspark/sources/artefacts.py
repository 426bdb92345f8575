"""Named datasets and the side artefacts that belong to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIMILAR = "document_id string, rank int, target_document_id string, case_signature string, decision_date_iso string, decision_type_ipo_label string, score double, components struct<lexical:double,citations:double,metadata:double,dotyczy_bigrams:double>, reasons array<string>, source_url string, dataset_hash string, schema_version string"


class Datasets:
    """Names and where their tables lie. A dataset that was uploaded has no side artefacts."""

    def __init__(self, places: dict[str, str]):
        self.places = dict(places)

    def path(self, name: str) -> str:
        if name not in self.places:
            raise KeyError(f"no dataset is named {name}; there are {', '.join(sorted(self.places))}")
        return self.places[name]

    def candidates(self, name: str, artefact: str) -> list[str]:
        """Where an artefact of a dataset may lie, the most specific place first."""
        return [f"{self.places[name]}/{artefact}", f"{self.places[name]}_{artefact}"] if name in self.places else []


def first_fitting(spark: SparkSession, paths: Sequence[str], schema: str, dataset_hash: str, versions: Sequence[str]) -> tuple[DataFrame | None, str]:
    """The first artefact that exists, has a known version and belongs to the dataset, and why the last other one did not fit."""
    why = "no artefact was found"
    for path in paths:
        try:
            rows = spark.read.schema(schema).json(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        head = rows.select("schema_version", "dataset_hash").first()
        if head is None or head["schema_version"] not in versions:
            why = f"{path} has an unknown version"
        elif head["dataset_hash"] != dataset_hash:
            why = f"{path} belongs to another dataset"
        else:
            return rows, ""
    return None, why


def similar(rows: DataFrame) -> DataFrame:
    """Entries of a similarity artefact, missing numbers as 0; those without a target or signature go."""
    named = (F.coalesce("target_document_id", F.lit("")) != "") & (F.coalesce("case_signature", F.lit("")) != "")
    part = lambda k: F.coalesce(F.col(f"components.{k}"), F.lit(0.0)).alias(k)
    return rows.where(named).withColumns({"score": F.coalesce("score", F.lit(0.0)), "components": F.struct(*map(part, ("lexical", "citations", "metadata", "dotyczy_bigrams")))})
