"""Raw decisions to normalized cases.

Column expressions derive everything that a row tells by itself. Three steps walk along a case's paragraphs in order, each
looking at what it has just decided (merging split dissent headings, reclassifying unknown paragraphs, the forced pass); they
run in a pandas UDF over the case's own array, so no case leaves its row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, dims
from ..functions.scalars import canonical_url, parse_date
from ..functions.text import fold_build, fold_plain, normalize_space

PARAGRAPH = (
    "paragraph_id string, paragraph_index int, paragraph_number string, section_key string, section_label string, section_confidence double, "
    "section_raw string, text string, section_reclassified_from string, section_reclass_reason string"
)
FIELDS = [f.split()[0] for f in PARAGRAPH.split(", ")]
PARAGRAPHS = "array<struct<" + ", ".join(":".join(f.split()) for f in PARAGRAPH.split(", ")) + ">>"
VERSION = "docket-norm-1"


def cases(raw: DataFrame, overrides: DataFrame | None = None, forced: bool = False, reader: bool = False) -> DataFrame:
    """Normalized cases. overrides: document_id, bench (a known key wins over the count of judges). forced: leave no paragraph
    unknown. reader: the profile for raw files that a reader opens: its own heading rules and confidences, no reclassification,
    a year from any four digits of the date."""
    empty = lambda c: F.nullif(normalize_space(c), F.lit(""))
    document = F.coalesce(empty("ids.document_id"), F.lit("doc"))
    names = F.filter(F.transform(F.coalesce("judges", F.array()), lambda j: normalize_space(j["name"])), lambda n: n != "")
    toc = F.filter(F.transform(F.coalesce("table_of_contents", F.array()), lambda t: F.struct(normalize_space(t["text"]).alias("text"), t["href"].alias("href"))), lambda t: t["text"] != "")
    date = parse_date("decision_date")
    written = normalize_space("decision_date")
    year = F.regexp_extract(written, r"((?:19|20)\d{2})", 1).try_cast("int") if reader else date["year"]
    out = raw.select(
        empty("ids.case_id").alias("case_id"), empty("ids.document_id").alias("document_id"), normalize_space("case_signature").alias("case_signature"), normalize_space("decision_type").alias("decision_type"),
        classify.decision_type("decision_type").alias("type"), normalize_space("decision_date").alias("decision_date_raw"), date["iso"].alias("decision_date_iso"), year.alias("year"),
        empty("topic").alias("topic"), empty("proceeding_intro").alias("proceeding_intro"), canonical_url("source_url", F.col("ids.case_id"), F.col("ids.document_id")).alias("source_url"),
        F.col("download.href").alias("download_url"), "publication_entries", "metadata", "judges", names.alias("judge_names"), F.size(names).alias("judge_count"),
        F.transform(toc, lambda t: t.withField("key", classify.section_of(t["text"], reader))).alias("table_of_contents"), classify.roman_map(toc, reader).alias("numerals"), F.coalesce("paragraphs", F.array()).alias("p"), document.alias("prefix"),
    )

    def one(p: Column, i: Column) -> Column:
        raw_section, text = normalize_space(p["section"]), normalize_space(p["text"])
        found = classify.resolve_section(raw_section, F.col("numerals"), reader)
        tenor = (found["key"] == dims.UNKNOWN) & classify.looks_like_tenor(text, p["paragraph_number"], i + 1)
        key, sure = F.when(tenor, "tenor").otherwise(found["key"]), F.when(tenor, 0.72).otherwise(found["confidence"])
        index = F.when(F.coalesce(p["paragraph_index"], F.lit(0)) == 0, i + 1).otherwise(p["paragraph_index"])
        values = [F.concat_ws("-", "prefix", (i + 1).cast("string")), index.cast("int"), F.nullif(normalize_space(p["paragraph_number"]), F.lit("")), key, classify.label_of(key), sure, F.nullif(raw_section, F.lit("")), text, F.lit(None).cast("string"), F.lit(None).cast("string")]
        return F.struct(*[v.alias(n) for v, n in zip(values, FIELDS)])

    out = out.withColumn("paragraphs", F.filter(F.transform("p", one), lambda p: p["text"] != "").cast(PARAGRAPHS))
    out = out.withColumn("paragraphs", walk(F.col("paragraphs"), F.col("decision_type"), F.lit(forced), F.lit(not reader)))
    out = with_bench(out, overrides)
    counts = F.transform(F.array(*map(F.lit, dims.SECTIONS)), lambda k: F.struct(k.alias("key"), F.size(F.filter("paragraphs", lambda p: p["section_key"] == k)).alias("value")))
    out = out.withColumns({"paragraph_count": F.size("paragraphs"), "section_counts": F.map_from_entries(F.filter(counts, lambda c: c["value"] > 0)), "normalization_version": F.lit(VERSION)})
    out = out.withColumns({f"decision_type_ipo_{k}": F.col(f"type.{k}") for k in ("key", "label", "visible")})
    return out.drop("type", "numerals", "p", "prefix")


def with_bench(rows: DataFrame, overrides: DataFrame | None = None, count: str = "judge_count", key: str = "document_id") -> DataFrame:
    """Bench columns from the number of judges, a known override first. Overrides are a small side table: Spark broadcasts it
    when its size allows."""
    found = classify.bench(F.col(count))
    if overrides is not None:
        known = overrides.select(F.trim(key).alias(key), F.col("bench").alias("bench_override")).where(F.col("bench_override").isin(*dims.BENCHES)).dropDuplicates([key])
        rows = rows.join(known, key, "left")
        official = classify.official_bench(F.coalesce("bench_override", found["key"]))
    else:
        official = classify.official_bench(found["key"])
    rows = rows.withColumns({"bench_size_key": found["key"], "bench_size_label": found["label"], "is_full_bench": official["key"] == "pelny_sklad", **{f"bench_size_ipo_{k}": official[k] for k in ("key", "label", "visible")}})
    return rows.drop("bench_override")


def nonempty(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases with paragraphs, and those without."""
    full = F.size("paragraphs") > 0
    return rows.where(full), rows.where(~full)


def errors(rows: DataFrame) -> Column:
    """How many things a case lacks: ids, signature, and texts, ids, sections or confidences of paragraphs."""
    lacks = lambda c: F.when(F.coalesce(c.cast("string"), F.lit("")) == "", 1).otherwise(0)
    own = lacks(F.col("document_id")) + lacks(F.col("case_signature")) + F.when(F.size("paragraphs") == 0, 1).otherwise(0)
    return own + F.aggregate("paragraphs", F.lit(0), lambda n, p: n + lacks(p["paragraph_id"]) + lacks(p["text"]) + lacks(p["section_key"]) + F.when(p["section_confidence"].isNull(), 1).otherwise(0))


def duplicate_ids(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Ids that are missing or occur more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def review(rows: DataFrame) -> DataFrame:
    """The report on reclassified paragraphs of normalized cases, a row for each: what it was and became, how sure, why, by which
    pass, and the text."""
    p = F.col("p")
    forced = p["section_reclass_reason"].startswith(dims.FORCED_PREFIX)
    changed = rows.select("document_id", "case_signature", F.explode(F.filter("paragraphs", lambda x: x["section_reclassified_from"].isNotNull())).alias("p"))
    return changed.select(
        "document_id", "case_signature", p["paragraph_id"].alias("paragraph_id"), p["paragraph_index"].alias("paragraph_index"), p["paragraph_number"].alias("paragraph_number"),
        p["section_reclassified_from"].alias("source_section_key"), p["section_key"].alias("predicted_section_key"), p["section_label"].alias("predicted_section_label"), p["section_confidence"].alias("confidence"),
        p["section_reclass_reason"].alias("reason"), F.when(forced, dims.FORCED_MODEL).alias("model"), p["text"].alias("text"),
    )


def review_counts(report: DataFrame) -> DataFrame:
    """model (null for the rules' pass), predicted_section_key, n: how many paragraphs each pass moved to each section."""
    return report.groupBy("model", "predicted_section_key").agg(F.count(F.lit(1)).alias("n"))


def prompt() -> str:
    """The instruction for a language model that predicts sections; predict() takes the callable that uses it."""
    return " ".join(dims.PROMPT).format(keys=", ".join(dims.SECTIONS))


# --- steps along the paragraphs ---

_re = {k: re.compile(getattr(classify, k), re.ASCII) for k in ("DIVIDER", "CONTINUATION", "SENTENCE_ORDERS", "SENTENCE_RULES", "HISTORY", "PROCEDURE", "REASONING")}
_SENTENCE_LINE = [re.compile(p, re.ASCII) for p in (r"^[-–—]", rf"^(art\.?|§|paragraf|pkt\.?|ust\.?|orzeczenie){classify.E}", classify.LIST_ITEM, rf"{classify.B}(jest|sa)\s+(niezgodn|zgodn|dopuszczaln|niedopuszczaln)", rf"{classify.B}(umorzyc|umarza|postanawia|orzeka|odmawia|odrzuca|oddalic){classify.E}")]
_JUDGE = re.compile(r"sedziego\s+tk", re.ASCII)
_JUDGE_LINE = re.compile(r"^sedziego\s+tk(?![A-Za-z0-9_])", re.ASCII)
_CONTINUED = ("do ", "z dnia ", "sygn.", "sygn ")


def merge_dissent(rows: list[dict]) -> list[dict]:
    """A dissent's judge line takes up the short lines behind it that go on with it."""
    out: list[dict] = []
    open_line = False  # whether the last row of out is a judge line that may go on
    for p in rows:
        norm = fold_plain(p["text"] or "", True)
        dissent = p["section_key"] == "zdanie_odrebne"
        if open_line and dissent and len(p["text"]) <= 220 and norm.startswith(_CONTINUED):
            head = out[-1]["text"]
            out[-1] = out[-1] | {"text": f"{head if out[-1].get('joined') else 'Zdanie odrębne ' + head} {p['text']}", "joined": True}
            continue
        open_line = dissent and bool(_JUDGE_LINE.match(norm))
        out.append(p)
    return [{k: v for k, v in p.items() if k != "joined"} for p in out]


class Walk:
    """A case's paragraphs with what the rules look at. Keys change while the walk goes on, so what lies behind shows earlier
    decisions and what lies ahead doesn't."""

    def __init__(self, rows: list[dict], decision_type: str | None):
        self.rows, self.type = rows, fold_plain(decision_type or "", True)
        self.keys = [p["section_key"] for p in rows]
        self.norm = [fold_plain(p["text"] or "", True) for p in rows]
        self.raw = [fold_plain(p["section_raw"] or "", True) for p in rows]

    def near(self, i: int, step: int, reach: int) -> tuple[str | None, int]:
        """(key, distance) of the next known section in a direction."""
        for d in range(1, reach + 1):
            j = i + step * d
            if not 0 <= j < len(self.keys):
                break
            if self.keys[j] != dims.UNKNOWN:
                return self.keys[j], d
        return None, reach + 1

    def infer(self, i: int) -> tuple[str, float, str] | None:
        """(section, confidence, reason) by the first rule that fits."""
        norm, raw = self.norm[i], self.raw[i]
        if not norm:
            return None
        place = (i + 1) / len(self.rows)
        (before, b), (after, a) = self.near(i, -1, dims.REACH), self.near(i, 1, dims.REACH)
        has = lambda *words: any(w in raw for w in words)
        found = lambda k: bool(_re[k].search(norm))
        sentence = place <= 0.35 and any(p.search(norm) for p in _SENTENCE_LINE)
        history = found("HISTORY")
        # The rules' order, sections, confidences and reasons.
        rules: list[tuple[bool, str | None, float, str]] = [
            (norm.startswith("zdanie odrebne"), "zdanie_odrebne", 0.98, "dissent-heading"),
            (has("trybunal zwazyl"), "uzasadnienie_prawne", 0.94, "raw-legal-heading"),
            (has("stan faktyczny", "wnioskiem z", "w skardze konstytucyjnej"), "uzasadnienie_historyczne", 0.9, "raw-history-heading"),
            (has("na rozprawie", "posiedzeniu"), "uzasadnienie_postepowanie", 0.9, "raw-procedure-heading"),
            (has("postanawia"), "postanawia", 0.9, "raw-postanawia-heading"),
            (has("orzeka"), "orzeka", 0.9, "raw-orzeka-heading"),
            (before is not None and before == after and b <= 2 and a <= 2, before, 0.95, "bridged-between-same-sections"),
            (found("DIVIDER") and a <= 2, after, 0.86, "section-divider-before-next-section"),
            (found("DIVIDER") and b <= 2, before, 0.83, "section-divider-after-prev-section"),
            (found("CONTINUATION") and b <= 3, before, 0.88, "continuation-of-previous-section"),
            (sentence and found("SENTENCE_ORDERS"), "postanawia", 0.9, "sentencja-postanawia-lexical"),
            (sentence and found("SENTENCE_RULES"), "orzeka", 0.88, "sentencja-orzeka-lexical"),
            (sentence and before in dims.SENTENCE_SECTIONS and b <= 4, before, 0.84, "sentencja-neighbor-prev"),
            (sentence and after in dims.SENTENCE_SECTIONS and a <= 4, after, 0.84, "sentencja-neighbor-next"),
            (sentence and "postanow" in self.type, "postanawia", 0.8, "decision-type-postanowienie"),
            (sentence, "tenor", 0.79, "early-sentencja-default"),
            (history and found("PROCEDURE"), "uzasadnienie_postepowanie", 0.84, "history-procedure-cues"),
            (history, "uzasadnienie_historyczne", 0.82, "history-cues"),
            (found("REASONING"), "uzasadnienie_prawne", 0.8, "legal-reasoning-cues"),
            (before in dims.REASONING_SECTIONS and place > 0.2 and b <= 4, before, 0.74, "reasoning-neighbor-prev"),
            (after in dims.REASONING_SECTIONS and place > 0.2 and a <= 4, after, 0.74, "reasoning-neighbor-next"),
        ]
        return next(((key, sure, why) for fits, key, sure, why in rules if fits), None)

    def forced(self, i: int) -> tuple[str, float, str]:
        """A section in any case."""
        norm, place = self.norm[i], (i + 1) / len(self.rows)
        if norm.startswith("zdanie odrebne") or _JUDGE.search(norm):
            return "zdanie_odrebne", *dims.FORCED["dissent"]
        if (guess := self.infer(i)) is not None:
            return guess[0], max(dims.FORCED_LEAST, guess[1]), dims.FORCED_PREFIX + guess[2]
        (before, b), (after, a) = self.near(i, -1, dims.FORCED_REACH), self.near(i, 1, dims.FORCED_REACH)
        if before and after:
            bias = lambda key, d: d - (1 if place <= 0.35 and key in dims.SENTENCE_SECTIONS else 0)
            return (before if bias(before, b) <= bias(after, a) else after), *dims.FORCED["nearest"]
        if before or after:
            return before or after, *dims.FORCED["previous" if before else "next"]
        if place <= 0.35:
            return ("postanawia", *dims.FORCED["early_order"]) if "postanow" in self.type else ("tenor", *dims.FORCED["early"])
        for cue, key, name in (("REASONING", "uzasadnienie_prawne", "legal"), ("PROCEDURE", "uzasadnienie_postepowanie", "procedure"), ("HISTORY", "uzasadnienie_historyczne", "history")):
            if _re[cue].search(norm):
                return key, *dims.FORCED[name]
        return ("uzasadnienie_prawne", *dims.FORCED["late"]) if place > 0.8 else ("uzasadnienie_historyczne", *dims.FORCED["other"])

    def apply(self, forced: bool) -> None:
        for i, key in enumerate(self.keys):
            if key != dims.UNKNOWN:
                continue
            guess = self.forced(i) if forced else self.infer(i)
            if guess is None or not forced and guess[1] < dims.LEAST_RECLASSIFIED:
                continue
            self.keys[i] = guess[0]
            p = self.rows[i]
            self.rows[i] = p | {
                "section_key": guess[0], "section_label": dims.SECTIONS[guess[0]], "section_confidence": round(max(p["section_confidence"] or 0.0, guess[1]), 2),
                "section_reclassified_from": dims.UNKNOWN, "section_reclass_reason": guess[2],
            }


def walk_paragraphs(rows: list[dict], decision_type: str | None, forced: bool = False, reclassify: bool = True) -> list[dict]:
    w = Walk(merge_dissent(rows), decision_type)
    if reclassify:
        w.apply(False)
    if forced:
        w.apply(True)
    return w.rows


def _walk(paragraphs: pd.Series, decision_type: pd.Series, forced: pd.Series, reclassify: pd.Series) -> pd.Series:
    return pd.Series([walk_paragraphs([dict(p) for p in ps], t, bool(f), bool(r)) for ps, t, f, r in zip(paragraphs, decision_type, forced, reclassify)])


def walk(paragraphs: Column, decision_type: Column, forced: Column, reclassify: Column | None = None) -> Column:
    # Marked so that the optimizer keeps it a column of its own: it can't run inside a lambda that reads its result.
    return F.pandas_udf(_walk, PARAGRAPHS).asNondeterministic()(paragraphs, decision_type, forced, F.lit(True) if reclassify is None else reclassify)


# --- the same looks as windows, on a long table ---


def neighbours(rows: DataFrame, case: str, place: str, key: str = "section_key", reach: int = dims.REACH) -> DataFrame:
    """prev_key, prev_distance, next_key, next_distance: the nearest known sections before and after within the reach."""
    own = Window.partitionBy(case).orderBy(place)
    ranked = rows.withColumn("nth", F.row_number().over(own))
    known = F.when(F.col(key) != dims.UNKNOWN, F.struct(F.col(key).alias("key"), F.col("nth").alias("at")))
    before = F.last(known, ignorenulls=True).over(own.rowsBetween(-reach, -1))
    after = F.first(known, ignorenulls=True).over(own.rowsBetween(1, reach))
    ranked = ranked.withColumns({"before": before, "after": after})
    return ranked.select(*rows.columns, F.col("before.key").alias("prev_key"), (F.col("nth") - F.col("before.at")).alias("prev_distance"), F.col("after.key").alias("next_key"), (F.col("after.at") - F.col("nth")).alias("next_distance"))


def islands(rows: DataFrame, case: str, place: str, continues: Column) -> DataFrame:
    """island: the number of the run that a row belongs to; a row that continues belongs to the run before."""
    own = Window.partitionBy(case).orderBy(place)
    return rows.withColumn("island", F.sum(F.when(continues, 0).otherwise(1)).over(own))


def merge_dissent_headings(rows: DataFrame, case: str, place: str, text: str = "text", key: str = "section_key") -> DataFrame:
    """The merge of split dissent headings by windows: case, place of the first row, merged text."""
    norm = fold_build(text)
    own = Window.partitionBy(case).orderBy(place)
    dissent = F.col(key) == "zdanie_odrebne"
    cont = dissent & (F.length(text) <= 220) & norm.rlike(r"^(do |z dnia |sygn[. ])") & F.coalesce(F.lag(dissent).over(own), F.lit(False))
    run = islands(rows.withColumn("continues", cont), case, place, F.col("continues"))
    first = Window.partitionBy(case, "island").orderBy(place)
    judge = F.first((F.col(key) == "zdanie_odrebne") & norm.rlike(r"^sedziego\s+tk(?![A-Za-z0-9_])")).over(first)
    run = run.withColumn("judge", judge).withColumn("run", F.when(F.col("judge"), F.lit(0)).otherwise(F.row_number().over(first)))
    joined = run.groupBy(case, "island", "run").agg(F.min(place).alias(place), F.array_sort(F.collect_list(F.struct(place, text))).alias("parts"), F.first("judge").alias("judge"))
    whole = F.concat_ws(" ", F.transform("parts", lambda p: p[text]))
    return joined.select(case, place, F.when(F.col("judge") & (F.size("parts") > 1), F.concat(F.lit("Zdanie odrębne "), whole)).otherwise(whole).alias("text"))


def unknown_candidates(rows: DataFrame, case: str, place: str, key: str = "section_key") -> DataFrame:
    """Unknown paragraphs with what stands before and after and where in the case they are."""
    own = Window.partitionBy(case)
    by = own.orderBy(place)
    out = rows.withColumns({"prev_key": F.lag(key).over(by), "next_key": F.lead(key).over(by), "position_ratio": F.round(F.row_number().over(by) / F.count(F.lit(1)).over(own), 4)})
    return out.where(F.col(key) == dims.UNKNOWN)


def merge_predictions(rows: DataFrame, predictions: DataFrame, least: float = dims.LEAST_PREDICTED, key: str = "section_key") -> DataFrame:
    """Unknown paragraphs take a predicted section that is known and sure enough. predictions: paragraph_id,
    predicted_section_key, confidence."""
    known = F.col("predicted_section_key").isin(*dims.SECTIONS)
    p = predictions.select("paragraph_id", F.when(known, F.col("predicted_section_key")).otherwise(dims.UNKNOWN).alias("predicted"), F.when(known, F.col("confidence")).otherwise(F.least("confidence", F.lit(0.4))).alias("sure")).dropDuplicates(["paragraph_id"])
    out = rows.join(p, "paragraph_id", "left").withColumns({"predicted": F.coalesce("predicted", F.lit(dims.UNKNOWN)), "sure": F.coalesce("sure", F.lit(0.01))})
    take = (F.col(key) == dims.UNKNOWN) & (F.col("predicted") != dims.UNKNOWN) & (F.col("sure") >= least)
    return out.withColumn("predicted_used", take).withColumn(key, F.when(F.col("predicted_used"), F.col("predicted")).otherwise(F.col(key))).drop("predicted", "sure")


def predict(candidates: DataFrame, predictor: Callable[[pd.DataFrame], pd.DataFrame], batch: int = 20, tries: int = 3) -> DataFrame:
    """paragraph_id, predicted_section_key, confidence, reason from a callable over small batches; a batch that fails is tried
    again, then left out."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for b in batches:
            for start in range(0, len(b), batch):
                for attempt in range(1, tries + 1):
                    try:
                        yield predictor(b.iloc[start : start + batch])[["paragraph_id", "predicted_section_key", "confidence", "reason"]]
                        break
                    except Exception:  # the callable is not ours: whatever it raises counts as a failed try
                        time.sleep(0.5 * attempt)

    return candidates.mapInPandas(work, "paragraph_id string, predicted_section_key string, confidence double, reason string")
