"""Writing cases, statistics and search results, stamped with where they come from."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field
from .arrays import parted

TOOL = "docketspark 0.1"


def dataset_hash(rows: DataFrame, order: str | None = None) -> str:
    """A digest of the content. With an order column the SHA-256 of all rows' JSON, line by line, in that order (a small table:
    it is put together in one place); without, one of the rows' digests whatever their order, added up in parallel."""
    if order:
        line = F.struct(F.col(order).alias("o"), F.to_json(F.struct(*sorted(c for c in rows.columns if c != order))).alias("j"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["j"]), "\n")
        return rows.agg(F.sha2(joined, 256).alias("h")).first()["h"]
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[part(i) for i in range(8)])
    return sums.select(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in sums.columns]), 256).alias("h")).first()["h"]


def stamped(rows: DataFrame, digest: str) -> DataFrame:
    return rows.withColumns({"dataset_hash": F.lit(digest), "dataset_generated_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")})


def write_cases(rows: DataFrame, path: str, order: Sequence[str] = ("decision_date_iso", "document_id"), samples: Sequence[int] = (50, 200)) -> None:
    """The cases as JSON lines, and the first few in order as samples."""
    rows.write.mode("overwrite").json(f"{path}/full")
    for n in samples:
        rows.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").json(f"{path}/sample{n}")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_arrays(rows: DataFrame, path: str) -> None:
    """Each part as a JSON array of its own, an element a line."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for b in parted(batches, 0):
            lines = []
            for x in b.column(0).to_pylist():
                lines.append(lead + x)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], names=["value"])

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInArrow(work, "value string").write.mode("overwrite").text(path)


def provenance(query: str, filters: dict[str, str], digest: str, generated_at: str) -> dict[str, Column]:
    """The six columns that every export begins with."""
    ordered = F.to_json(F.struct(*[F.lit(filters[k]).alias(k) for k in sorted(filters)])) if filters else F.lit("{}")
    return {"dataset_hash": F.lit(digest), "dataset_generated_at": F.lit(generated_at), "query": F.lit(query), "filters": ordered, "exported_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "tool": F.lit(TOOL)}


def with_provenance(rows: DataFrame, **stamp: object) -> DataFrame:
    made = provenance(**stamp)
    return rows.select(*[c.alias(k) for k, c in made.items()], *rows.columns)


def csv_lines(rows: DataFrame) -> DataFrame:
    """Each row as a line of CSV; only quotes, commas and line feeds make a field quoted."""
    return rows.select(F.concat_ws(",", *[csv_field(c) for c in rows.columns]).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    """The header and the lines as text files."""
    head = rows.sparkSession.createDataFrame([(",".join(rows.columns),)], "value string")
    head.unionByName(csv_lines(rows)).write.mode("overwrite").text(path)


def quote_package(chosen: DataFrame, paragraphs: DataFrame, case: str, place: str, key: str = "paragraph_id") -> DataFrame:
    """Chosen paragraphs with those before and after."""
    from ..operators.search import context

    around = context(paragraphs, case, place, [key, "text"])
    return around.join(chosen.select(key).distinct(), key, "left_semi")


def dossier(query: str, filters: dict[str, str], notes: str, cases: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """One row of JSON with the pinned cases and paragraphs (a user's own short lists)."""
    listed = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    both = listed(cases, "cases").crossJoin(F.broadcast(listed(paragraphs, "paragraphs")))
    return both.select(F.to_json(F.struct(F.lit(query).alias("query"), F.to_json(F.struct(*[F.lit(filters[k]).alias(k) for k in sorted(filters)] or [F.lit("").alias("none")])).alias("filters"), F.lit(notes).alias("notes"), "cases", "paragraphs")).alias("document"))


def card(summary: dict[str, object], digest: str, sizes: dict[str, int]) -> str:
    """A short text about a dataset."""
    lines = ["# Dataset", "", f"hash: {digest}", "", *[f"- {k}: {v}" for k, v in summary.items()], "", *[f"- {p}: {n} bytes" for p, n in sorted(sizes.items())]]
    return "\n".join(lines) + "\n"


def stale(remote: DataFrame, keep: DataFrame) -> DataFrame:
    """Paths that are no longer kept."""
    return remote.select("path").distinct().join(keep.select("path"), "path", "left_anti")
