"""Case records as the reader sees them: repair of normalized rows, metrics, citations, key figures, export layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dims
from ..functions.scalars import canonical_url, format_date, one_of
from ..functions.text import fold_search, normalize_space
from ..sources.sinks import with_provenance
from . import normalize
from .search import context


def _empty(c: Column | str) -> Column:
    return F.nullif(normalize_space(c), F.lit(""))


def sanitized(rows: DataFrame) -> DataFrame:
    """Normalized cases with what they lack filled in again; applied twice it changes nothing. An early paragraph of unknown
    section becomes the operative part but keeps the label that it came with. Cases without paragraphs go."""
    names = F.filter(F.transform(F.coalesce("judge_names", F.array()), lambda n: normalize_space(n)), lambda n: n != "")

    def one(p: Column, i: Column) -> Column:
        text = normalize_space(p["text"])
        known = F.coalesce(p["section_key"], classify.section_of(p["section_raw"]))
        tenor = (known == dims.UNKNOWN) & classify.looks_like_tenor(text, p["paragraph_number"], i + 1)
        key = F.when(tenor, "tenor").otherwise(known)
        sure = F.when(tenor, 0.72).otherwise(F.coalesce(p["section_confidence"], F.when(known == dims.UNKNOWN, 0.35).otherwise(0.95)))
        index = F.coalesce(F.nullif(p["paragraph_index"], F.lit(0)), i + 1).cast("int")
        values = [
            F.coalesce(p["paragraph_id"], F.concat_ws("-", F.coalesce("document_id", F.lit("doc")), (i + 1).cast("string"))), index, _empty(p["paragraph_number"]), key,
            F.coalesce(p["section_label"], classify.label_of(key)), F.round(sure, 2), _empty(p["section_raw"]), text, p["section_reclassified_from"], p["section_reclass_reason"],
        ]
        return F.struct(*[v.alias(n) for v, n in zip(values, normalize.FIELDS)])

    kind = F.coalesce(_empty("decision_type"), F.lit("Nieustalony typ"))
    derived = classify.decision_type(kind)
    given = _empty("decision_type_ipo_key").isNotNull() & _empty("decision_type_ipo_label").isNotNull()
    iso, written = _empty("decision_date_iso"), normalize_space("decision_date_raw")
    year = F.coalesce("year", F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(iso, 1, 4).try_cast("int")), F.regexp_extract(written, r"((?:19|20)\d{2})", 1).try_cast("int"))
    ps = F.filter(F.transform(F.coalesce("paragraphs", F.array().cast(normalize.PARAGRAPHS)), one), lambda p: p["text"] != "").cast(normalize.PARAGRAPHS)
    out = rows.withColumns(
        {
            "paragraphs": ps, "judge_names": names, "judge_count": F.coalesce("judge_count", F.size(names)), "year": year, "decision_type": kind, "decision_date_iso": iso, "topic": _empty("topic"),
            "decision_type_ipo_key": F.when(given, F.col("decision_type_ipo_key")).otherwise(derived["key"]), "decision_type_ipo_label": F.when(given, F.col("decision_type_ipo_label")).otherwise(derived["label"]),
            "source_url": canonical_url("source_url", F.col("case_id"), F.col("document_id")),
        }
    )
    own = classify.bench(F.col("judge_count"))
    out = out.withColumn("bench_size_key", F.coalesce(_empty("bench_size_key"), own["key"]))
    official = classify.official_bench(F.col("bench_size_key"))
    out = out.withColumns({"bench_size_ipo_key": F.coalesce(_empty("bench_size_ipo_key"), official["key"]), "bench_size_ipo_label": F.coalesce(_empty("bench_size_ipo_label"), official["label"])})
    return out.withColumn("paragraph_count", F.size("paragraphs")).where(F.col("paragraph_count") > 0)


def is_normalized(paragraphs: Column) -> Column:
    """Whether a row comes from normalization: its first paragraph has a section key."""
    return F.get(paragraphs, 0)["section_key"].isNotNull()


def metric(part: str, named: str) -> Column:
    """(text, preview) of a part of the case metric, the metadata's entry if it is not there; the preview is the first three
    acts and how many more, or the first 90 characters."""
    own, acts = F.col(f"case_metric.{part}"), F.transform(F.coalesce(F.col(f"case_metric.{part}.acts"), F.array()), lambda a: a["act"])
    present = F.coalesce(own["present"], F.lit(False))
    text = F.when(present, normalize_space(own["text"])).otherwise(normalize_space(F.try_element_at("metadata", F.lit(named))))
    more = F.size(acts) - 3
    listed = F.concat(F.array_join(F.slice(acts, 1, 3), "; "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(""))
    return F.struct(text.alias("text"), F.when(present & (F.size(acts) > 0), listed).otherwise(F.substring(text, 1, 90)).alias("preview"))


def standard(part: str = "wzorce", named: str = "Wzorce") -> Column:
    """The folded text of a case's standards of review: text, items, acts and their items; the metadata's entry otherwise."""
    own = F.col(f"case_metric.{part}")
    acts = F.flatten(F.transform(F.coalesce(own["acts"], F.array()), lambda a: F.concat(F.array(F.coalesce(a["act"], F.lit(""))), F.coalesce(a["items"], F.array()))))
    whole = F.concat_ws(" ", own["text"], own["items"], acts)
    return fold_search(F.when(F.coalesce(own["present"], F.lit(False)), whole).otherwise(F.try_element_at("metadata", F.lit(named))))


def blob(case_columns: list[str], hit_texts: Column) -> Column:
    """What a second filter searches: a case's fields and its first hits, folded."""
    return fold_search(F.concat_ws(" ", *case_columns, F.array_join(F.slice(hit_texts, 1, dims.BLOB_HITS), " ")))


def publication(entries: Column) -> Column:
    """The first publication in one form (`OTK ZU 2016, nr A, poz. 3`)."""
    first = F.regexp_replace(F.coalesce(F.get(F.filter(F.transform(F.coalesce(entries, F.array()), lambda e: normalize_space(e["text"])), lambda t: t != ""), 0), F.lit("")), r"\.$", "")
    letter, plain = r"(?i)^OTK\s+ZU\s+([A-Z])/(\d{4}),\s*poz\.\s*(\d+).*$", r"(?i)^OTK\s+ZU\s+(\d{4}),\s*nr\s*([^,]+?)\s*,\s*poz\.\s*(\d+).*$"
    return F.when(first.rlike(letter), F.regexp_replace(first, letter, "OTK ZU $2, nr $1, poz. $3")).otherwise(F.regexp_replace(first, plain, "OTK ZU $1, nr $2, poz. $3"))


def citation() -> Column:
    """A case's citation: kind and date, signature without trailing stars, publication."""
    norm = fold_search("decision_type")
    kind = F.when(norm.contains("wyrok"), "wyrok TK").when(norm.contains("postanow"), "postanowienie TK").otherwise("orzeczenie TK")
    written = normalize_space("decision_date_raw")
    fallback = F.when(written == "", "brak daty").when(written.rlike(r"(?i)(?<![A-Za-z0-9_])r\.$"), written).otherwise(F.concat(written, F.lit(" r.")))
    date = F.when(F.try_to_date("decision_date_iso").isNotNull(), F.concat(format_date("decision_date_iso"), F.lit(" r."))).otherwise(fallback)
    signature = F.regexp_replace(normalize_space("case_signature"), r"\s*\*+\s*$", "")
    parts = F.array(F.concat_ws(" z dnia ", kind, date), signature, publication(F.col("publication_entries")))
    return F.array_join(F.filter(parts, lambda p: p != ""), ", ")


def paragraph_citation() -> Column:
    number = F.coalesce(F.col("paragraph_number"), F.concat(F.lit("§ "), F.col("paragraph_index").cast("string")))
    return F.concat_ws(", ", citation(), "section_label", number)


def key_figures(rows: DataFrame) -> DataFrame:
    """Cases, dated cases, full benches, paragraphs and their mean, in one row."""
    return rows.agg(F.count(F.lit(1)).alias("cases"), F.count("decision_date_iso").alias("dated"), F.count_if("is_full_bench").alias("full_bench"), F.coalesce(F.sum("paragraph_count"), F.lit(0)).alias("paragraphs"), F.round(F.avg("paragraph_count"), 2).alias("mean_paragraphs"))


def search_export(hits: DataFrame, **stamp: object) -> DataFrame:
    """The 18 columns of a search export: provenance and the hit."""
    explain = F.concat(F.lit("sekcja="), F.format_string("%.2f", one_of(F.col("section_key"), dims.SEARCH_WEIGHTS, 1.0)))
    rows = hits.select("case_signature", "document_id", "paragraph_index", "paragraph_number", "section_key", "section_label", F.col("decision_date_iso").alias("decision_date"), "decision_type", "source_url", "score", explain.alias("score_explain"), "text")
    return with_provenance(rows, **stamp)


def quote_export(chosen: DataFrame, paragraphs: DataFrame, **stamp: object) -> DataFrame:
    """The 20 columns of a package of quotes: each chosen paragraph with its citation and what stands before and after."""
    around = context(paragraphs, "document_id", "place", ["paragraph_id", "text"])
    rows = around.join(chosen.select("document_id", "paragraph_id").distinct(), ["document_id", "paragraph_id"], "left_semi")
    out = rows.select(
        "case_signature", "document_id", "paragraph_index", "paragraph_number", "section_key", "source_url", paragraph_citation().alias("citation"), F.lit("±1").alias("context_window"),
        F.col("prev_paragraph_id").alias("previous_paragraph_id"), F.col("prev_text").alias("previous_paragraph"), F.col("paragraph_id").alias("quoted_paragraph_id"), F.col("text").alias("quoted_paragraph"),
        "next_paragraph_id", F.col("next_text").alias("next_paragraph"),
    )
    return with_provenance(out, **stamp)


def lookup(rows: DataFrame, document_id: str, paragraph_id: str | None = None) -> DataFrame:
    """A case's or a paragraph's row by key; both are pushed to the scan."""
    found = rows.where(F.col("document_id") == document_id)
    return found if paragraph_id is None else found.where(F.col("paragraph_id") == paragraph_id)
