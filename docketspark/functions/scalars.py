"""Dates, citations, signatures, addresses and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims
from .text import _col, fold_build, normalize_space


def one_of(c: Column, values: dict[str, object], default: object = None) -> Column:
    """A lookup in a small fixed table."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)
    return found if default is None else F.coalesce(found, F.lit(default))


def parse_date(c: Column | str) -> Column:
    """(iso, year) of `d.m.yyyy`, `d month yyyy` (Polish genitive) or ISO; nulls for anything else. Days are not checked
    against the calendar."""
    text = normalize_space(c)
    at = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    dotted, worded, iso = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", r"^(\d{1,2})\s+(\p{L}+)\s+(\d{4})$", r"^(\d{4})-(\d{2})-(\d{2})$"
    month = one_of(fold_build(at(worded, 2)), {m: f"{i:02d}" for i, m in enumerate(dims.MONTHS, 1)})
    joined = F.concat_ws("-", at(dotted, 3), F.lpad(at(dotted, 2), 2, "0"), F.lpad(at(dotted, 1), 2, "0"))
    value = F.when(text.rlike(dotted), joined).when(text.rlike(worded) & month.isNotNull(), F.concat_ws("-", at(worded, 3), month, F.lpad(at(worded, 1), 2, "0"))).when(text.rlike(iso), text)
    return F.struct(value.alias("iso"), F.substring(value, 1, 4).cast("int").alias("year"))


def to_timestamp_ms(c: Column | str) -> Column:
    """Milliseconds since 1970 of an ISO date; 0 if it is none."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(_col(c))), F.lit(0).cast("long"))


def format_date(c: Column | str) -> Column:
    """`3 września 2019` for an ISO date, `brak daty` for none."""
    names = ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia")
    day = F.try_to_date(_col(c))
    name = F.element_at(F.array(*map(F.lit, names)), F.month(day))
    return F.when(day.isNull(), "brak daty").otherwise(F.concat_ws(" ", F.dayofmonth(day).cast("string"), name, F.year(day).cast("string")))


def roman(c: Column | str) -> Column:
    """A leading Roman numeral, in capitals; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(normalize_space(c), r"(?i)^([IVXLCDM]+)(?:(?![A-Za-z0-9_])|\s*[-–:])", 1)), F.lit(""))


def repertory(signature: Column | str) -> Column:
    """The letters that a signature begins with."""
    return F.upper(F.regexp_extract(normalize_space(signature), r"^([A-Za-z]{1,4})(?![A-Za-z0-9_])", 1))


def year_proximity(a: Column, b: Column) -> Column:
    """1 for the same year, falling to 0 over the window; 0 if one is missing."""
    gap = F.least(F.abs(a - b), F.lit(dims.YEAR_WINDOW)) / F.lit(float(dims.YEAR_WINDOW))
    return F.coalesce(F.greatest(F.lit(0.0), 1 - gap), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if one is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def weighted_overlap(common: Column, total_a: Column, total_b: Column) -> Column:
    """Weighted Jaccard from the sum of minima and the two totals, 6 decimals; 0 without anything."""
    whole = total_a + total_b - common
    return F.when(whole > 0, F.round(common / whole, 6)).otherwise(0.0)


def metadata_score(same_repertory: Column, same_bench: Column, proximity: Column, judges: Column) -> Column:
    w = dims.METADATA_WEIGHTS
    return F.round(w["repertory"] * same_repertory.cast("double") + w["bench"] * same_bench.cast("double") + w["year"] * proximity + w["judges"] * judges, 6)


def final_score(lexical: Column, citations: Column, metadata: Column, bigrams: Column) -> Column:
    w = dims.FINAL_WEIGHTS
    return F.round(w["lexical"] * lexical + w["citations"] * citations + w["metadata"] * metadata + w["dotyczy_bigrams"] * bigrams, 6)


def section_bucket(key: Column | str) -> Column:
    return one_of(_col(key), dims.BUCKETS, "inne")


CITATION = r"art\.?\s*(\d+[a-z]?)(?:\s*ust\.?\s*(\d+[a-z]?))?(?:\s*§\s*(\d+[a-z]?))?(?:\s*pkt\.?\s*(\d+[a-z]?))?"
PARAGRAPH_SIGN = r"§\s*(\d+[a-z]?)"


def citations(c: Column | str) -> Column:
    """All citations of a text in one form (`art. 32 ust. 1`); paragraph signs alone count only where no article is cited.
    An article may stand within a word."""
    text = F.lower(normalize_space(c))

    def canonical(m: Column) -> Column:
        full = F.regexp_replace(m, CITATION, "art. $1 ust. $2 § $3 pkt $4")
        return F.trim(F.regexp_replace(full, r"(ust\.|§|pkt) +(?=[u§p]|$)", ""))

    articles = F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)), canonical)
    signs = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH_SIGN), F.lit(1)), lambda x: F.concat(F.lit("§ "), x))
    return F.when(text.rlike(r"art\.?\s*\d"), articles).otherwise(signs)


def case_key(document_id: Column | str, signature: Column | str) -> Column:
    return F.coalesce(F.nullif(F.trim(_col(document_id)), F.lit("")), _col(signature))


def paragraph_key(case: Column, paragraph_id: Column) -> Column:
    return F.concat_ws("::", case, paragraph_id)


def canonical_url(url: Column | str, case_id: Column, document_id: Column) -> Column:
    """The portal's address of a decision if both ids are known, else the given one, else null. Ids that are missing are
    taken from an address of the portal."""
    given = F.nullif(F.trim(_col(url)), F.lit(""))
    host = F.try_parse_url(given, F.lit("HOST"))
    query = lambda k: F.when(host == dims.PORTAL_HOST, F.try_parse_url(given, F.lit("QUERY"), F.lit(k)))
    case = F.coalesce(F.nullif(F.trim(case_id), F.lit("")), query("sprawa"))
    document = F.coalesce(F.nullif(F.trim(document_id), F.lit("")), query("dokument"))
    made = F.concat(F.lit(f"https://{dims.PORTAL_HOST}/ipo/Sprawa?dokument="), F.url_encode(document), F.lit("&sprawa="), F.url_encode(case))
    return F.coalesce(made, given)


def dissent_judge(c: Column | str) -> Column:
    """The judge that a dissent's heading names, or the heading's first 72 characters."""
    text = normalize_space(c)
    name = r"(?i)zdanie odrębne\s+(?:sędziego|sędzi)\s+(?:tk\s+)?(.+?)(?=\s+(?:do|od|z dnia|sygn)\b|$)"
    short = r"(?i)^(?:sędziego|sędzi)\s+(?:tk\s+)?(.+?)(?=\s+(?:do|od|z dnia|sygn)\b|$)"
    get = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))
    return F.coalesce(get(name), get(short), F.substring(text, 1, 72))
