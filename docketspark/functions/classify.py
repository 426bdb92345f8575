"""Rules that classify headings, paragraphs, decisions and benches: ordered conditions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims
from .scalars import one_of, roman
from .text import _col, fold_build, normalize_space

#: No word character before or after, in ASCII.
B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def _has(norm: Column, *needles: str) -> Column:
    return reduce(lambda a, b: a | b, [norm.contains(n) for n in needles])


def section_of_folded(norm: Column, reader: bool = False) -> Column:
    """The section that a folded heading names; the first rule that fits decides. The reader's own rules test dissents after
    the orders and know fewer words."""
    reasoning = (
        F.when(_has(norm, "historycz"), "uzasadnienie_historyczne").when(_has(norm, "rozpraw", "posiedzen"), "uzasadnienie_postepowanie")
        .when(_has(norm, "prawne"), "uzasadnienie_prawne").otherwise("uzasadnienie_ogolne")
    )
    rules = {
        "komparycja": (_has(norm, "komparycja"), "komparycja"),
        "tenor": (_has(norm, "tenor"), "tenor"),
        "dissent": (_has(norm, "zdanie odrebne"), "zdanie_odrebne"),
        "rule": (_has(norm, "orzeka"), "orzeka"),
        "order": (_has(norm, "postanawia", "umorzyc postepowanie"), "postanawia"),
        "sentence": (_has(norm, "sentencja"), "sentencja_inna"),
        "reasoning": (_has(norm, "uzasadnienie"), reasoning),
        "history": (_has(norm, "czesc history"), "uzasadnienie_historyczne"),
        "procedure": (_has(norm, "czesc na rozpraw", "czesc przed rozpraw", "posiedzen"), "uzasadnienie_postepowanie"),
    }
    order = ("komparycja", "tenor", "rule", "order", "dissent", "reasoning") if reader else tuple(rules)
    out = F.lit(dims.UNKNOWN)
    for name in reversed(order):
        test, key = rules[name]
        out = F.when(test, key).otherwise(out)
    return out


def section_of(c: Column | str, reader: bool = False) -> Column:
    from .text import fold_search

    return section_of_folded(fold_search(c) if reader else fold_build(c), reader)


def label_of(key: Column) -> Column:
    return one_of(key, dims.SECTIONS)


def roman_map(toc: Column, reader: bool = False) -> Column:
    """Roman numeral -> section from a table of contents (array of structs with text). The last entry of a numeral wins. A whole
    title is classified first, then without its numeral; by the reader's rules without it only."""

    def entry(t: Column) -> Column:
        text = normalize_space(t["text"])
        rest = section_of(F.regexp_replace(text, r"(?i)^([IVXLCDM]+)\s*[-–:]?\s*", ""), reader)
        whole = F.lit(dims.UNKNOWN) if reader else section_of(text)
        return F.struct(roman(text).alias("key"), F.when(whole != dims.UNKNOWN, whole).otherwise(rest).alias("value"))

    known = F.filter(F.transform(F.coalesce(toc, F.array()), entry), lambda e: e["key"].isNotNull() & (e["value"] != dims.UNKNOWN))
    last = F.filter(known, lambda e, i: ~F.exists(F.slice(known, i + 2, F.greatest(F.size(known), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def resolve_section(raw: Column, numerals: Column, reader: bool = False) -> Column:
    """(key, confidence) of a paragraph's own heading: its words, a Roman prefix, a bare numeral, or unknown."""
    direct, number = section_of(raw, reader), F.try_element_at(numerals, roman(raw))
    bare = F.lit(None).cast("string") if reader else F.when(raw.rlike(r"(?i)^[IVXLCDM]+$"), F.try_element_at(numerals, F.upper(raw)))
    key = F.when(direct != dims.UNKNOWN, direct).otherwise(F.coalesce(number, bare, F.lit(dims.UNKNOWN)))
    own, prefixed = (0.95, 0.88) if reader else (0.98, 0.90)
    sure = F.when(direct != dims.UNKNOWN, own).when(number.isNotNull(), prefixed).when(bare.isNotNull(), 0.88).otherwise(0.35)
    return F.struct(key.alias("key"), sure.alias("confidence"))


def looks_like_tenor(text: Column, number: Column, position: Column) -> Column:
    """Early paragraphs that hold the operative part. position counts from 1."""
    norm = fold_build(text)
    numbered = F.coalesce(F.nullif(F.trim(number), F.lit("")), F.lit("")) != ""
    early = ((position <= 3) & numbered) | ((position <= 2) & norm.startswith("czy ")) | ((position <= 3) & norm.rlike(B + r"art\.?\s*\d"))
    return (norm != "") & early


def bench(count: Column) -> Column:
    """(key, label, full) for a number of judges."""
    key = F.when(count >= 11, "pelny_sklad").when(count == 5, "piecioosobowa").when(count == 3, "trojosobowa").when(count > 0, F.concat(count.cast("string"), F.lit("_osobowa"))).otherwise("nieustalony")
    label = F.coalesce(one_of(key, dims.BENCHES), F.when(count > 0, F.concat(count.cast("string"), F.lit("-osobowa"))).otherwise("Nieustalony"))
    return F.struct(key.alias("key"), label.alias("label"), (count >= 11).alias("full"))


def official_bench(key: Column) -> Column:
    """(key, label, visible): the three official benches; all others are outside."""
    known = one_of(key, dims.BENCHES)
    return F.struct(F.when(known.isNotNull(), key).otherwise(dims.OUTSIDE_BENCH).alias("key"), F.coalesce(known, F.lit("Poza klasyfikacją IPO")).alias("label"), known.isNotNull().alias("visible"))


def decision_type(c: Column | str) -> Column:
    """(key, label, visible) of a decision's name; null and invisible for types outside the taxonomy."""
    norm = fold_build(c)
    key = (
        F.when(_has(norm, "postanow") & _has(norm, "tymczas"), "postanowienie_tymczasowe").when(_has(norm, "postanow"), "postanowienie")
        .when(_has(norm, "rozstrzyg"), "rozstrzygniecie").when(_has(norm, "wyrok"), "wyrok")
    )
    return F.struct(key.alias("key"), one_of(key, dims.DECISION_TYPES).alias("label"), key.isNotNull().alias("visible"))


# Cues on folded paragraphs. The words of the domain.
DIVIDER = r"(?i)^([ivxlcdm]+)\.?$|^czesc\s+[ivxlcdm]+"
CONTINUATION = rf"^[-–—]|^(oraz|a takze|w zwiazku z|z art\.|z dnia){E}"
LIST_ITEM = r"(?i)^(\(?\d{1,3}[).]|[a-z][).]|[ivxlcdm]+\.)\s+"
SENTENCE_LINE = rf"^[-–—]|^(art\.?|§|paragraf|pkt\.?|ust\.?|orzeczenie){E}|{LIST_ITEM}|{B}(jest|sa)\s+(niezgodn|zgodn|dopuszczaln|niedopuszczaln)|{B}(umorzyc|umarza|postanawia|orzeka|odmawia|odrzuca|oddalic){E}"
SENTENCE_ORDERS = rf"{B}(postanawia|umorzyc|umarza|odmawia|odrzuca|pozostawic bez rozpoznania){E}"
SENTENCE_RULES = rf"{B}(orzeka|stwierdza){E}"
HISTORY = rf"{B}(wnioskiem z dnia|w skardze konstytucyjnej|postepowanie zostalo|prokurator generalny|marszalek sejmu|uczestnik postepowania|stan faktyczny|w pismie z|na rozprawie){E}"
PROCEDURE = rf"{B}(na rozprawie|na posiedzeniu|przed rozprawa){E}"
REASONING = rf"{B}(trybunal konstytucyjny zwazyl|w ocenie trybunalu|nalezy uznac|wzorcem kontroli|kontrola konstytucyjnosci|narusza zasade|zgodnie z utrwalonym orzecznictwem){E}"


def heading_like(c: Column | str) -> Column:
    """Whether a short paragraph reads like a heading."""
    text = normalize_space(c)
    words = F.size(F.split(text, " "))
    short = (text != "") & (F.length(text) <= 140) & (words <= 12) & ~text.rlike(rf"(?i){B}art\.?\s*\d")
    ended = text.rlike(r"[.:]$")
    named = fold_build(text).rlike(rf"^(przedmiot|stan faktyczny|ocena|uzasadnienie|konkluzja|wniosek){E}")
    looks = (text.rlike(r"(?i)^(\d+|[ivxlcdm]+)[.)]\s+") & ended) | (text.rlike(r"^§\s*\d+") & ended) | (text.rlike(r"^[\p{L}\p{N}\s\-–,]+[:.]$") & (words <= 8)) | (named & ended)
    return short & looks
