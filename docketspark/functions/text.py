"""Text functions as Column expressions: folds, tokens, occurrences, snippets' pieces. No Python runs on rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is to become one space: a run of several, or one that is no plain space. Single spaces stay, so most of a
#: text is copied in long pieces.
_RUNS = r"(?U)\s(?:\s+|(?<! ))"
SPLIT = r"[^\p{L}\p{N}]+"
WORD_SPLIT = r"[^\p{L}\p{N}_-]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def fold_table() -> tuple[str, str]:
    """Characters whose decomposition is one base letter and marks from U+0300 to U+036F, and those letters; then the marks
    themselves, which translate() deletes as they have no counterpart."""
    source, target = [], []
    for code in range(0x80, 0x2FFFF):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF or 0x300 <= code <= 0x36F:
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ")
        if len(base) == 1 and base != c:
            source.append(c)
            target.append(base)
    return "".join(source) + "".join(map(chr, range(0x300, 0x370))), "".join(target)


def fold_plain(text: str, build: bool = False) -> str:
    """The folds in Python, for queries and constants on the driver."""
    text = " ".join(text.replace(" ", " ").split()).lower()
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")
    return text.replace("ł", "l") if build else text


def normalize_space(c: Column | str) -> Column:
    """One space for every run of white space (the no-break one included), none at the ends; empty for null."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), _RUNS, " "))


def _single(c: Column | str, spaced: bool) -> Column:
    """spaced: normalize_space() has made the text, so it need not be looked through again."""
    return _col(c) if spaced else normalize_space(c)


def fold_search(c: Column | str, spaced: bool = False) -> Column:
    """Lower case without accents; ł stays."""
    return F.translate(F.lower(_single(c, spaced)), *fold_table())


def fold_build(c: Column | str, spaced: bool = False) -> Column:
    """Lower case without accents, ł as l."""
    source, target = fold_table()
    return F.translate(F.lower(_single(c, spaced)), "ł" + source, "l" + target)


def legal(c: Column | str, spaced: bool = False) -> Column:
    """The search fold with citations in one form: `art. 32` as `art32`, a space on both sides of `§`."""
    joined = F.regexp_replace(fold_search(c, spaced), r"art(?<![A-Za-z0-9_]art)\.?\s*(\d+[a-z]?)", "art$1")
    return F.trim(F.replace(F.regexp_replace(joined, " ?§ ?", " § "), F.lit("  "), F.lit(" ")))


def legal_plain(text: str) -> str:
    import re

    joined = re.sub(r"(?<![A-Za-z0-9_])art\.?\s*(\d+[a-z]?)", r"art\1", fold_plain(text), flags=re.ASCII)
    return " ".join(re.sub(r"\s*§\s*", " § ", joined).split())


def strip_token(c: Column | str) -> Column:
    """A folded token without all that is no letter or digit."""
    return F.regexp_replace(fold_build(c), SPLIT, "")


def tokens(c: Column | str, stopwords: Sequence[str] = (), least: int = 3, spaced: bool = False) -> Column:
    """Folded words of some length that are neither numbers nor stop words, repeats included."""
    words = F.split(fold_build(c, spaced), SPLIT)
    keep = lambda t: (F.length(t) >= least) & ~t.rlike(r"^\d+$") & ~t.isin(*stopwords) if stopwords else (F.length(t) >= least) & ~t.rlike(r"^\d+$")
    return F.filter(words, keep)


def surface_tokens(c: Column | str, stopwords: Sequence[str], spaced: bool = False) -> Column:
    """(token, norm) pairs for bigrams: the word as written in lower case, and its fold, by which it is filtered."""
    words = F.split(F.lower(_single(c, spaced)), SPLIT)
    folded = F.split(F.translate(F.array_join(words, "\n"), "ł" + fold_table()[0], "l" + fold_table()[1]), "\n")  # all at once
    pairs = F.zip_with(words, folded, lambda t, n: F.struct(t.alias("token"), n.alias("norm")))
    return F.filter(pairs, lambda p: (F.length(p["norm"]) >= 3) & ~p["norm"].isin(*stopwords) & ~p["norm"].rlike(r"^\d+$"))


def lemma_tokens(c: Column | str, spaced: bool = False) -> Column:
    """Words of the citation form, hyphens and underscores inside words kept."""
    return F.array_remove(F.split(legal(c, spaced), WORD_SPLIT), "")


def adjacent(array: Column) -> Column:
    """Pairs (a, b) of neighbours."""
    n = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs, without overlaps; 0 for an empty term."""
    if not term:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")


def truncate(c: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n)), F.lit(tail))).otherwise(c)


def slug(c: Column | str) -> Column:
    """Folded, everything but a-z, 0-9, _ and - as one dash, no dash at the ends."""
    return F.regexp_replace(F.regexp_replace(fold_search(c), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", "")


def snippet(source: Column, form: Column, terms: Sequence[str], width: int, lead: int = 120, anchor: Column | None = None) -> Column:
    """A window of the text that begins `lead` characters before the first term (or the anchor). source: the text with single
    spaces; form: its citation form, in which the term is looked for; the offset is applied to the source as it is."""
    head = truncate(source, width)
    if not terms:
        return head
    places = [F.nullif(F.locate(t, form), F.lit(0)) - 1 for t in terms]
    first = F.least(*places) if len(places) > 1 else places[0]
    if anchor is not None:
        first = F.coalesce(first, F.when(anchor >= 0, anchor))
    start = F.greatest(first - lead, F.lit(0))
    n = F.length(source)
    body = F.concat(F.when(start > 0, "...").otherwise(""), F.trim(F.substring(source, start + 1, F.lit(width))), F.when(start + width < n, "...").otherwise(""))
    return F.when(n <= width, source).when(first.isNull(), head).otherwise(body)


def replace_all(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape_html(c: Column | str) -> Column:
    return replace_all(_col(c), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def csv_field(c: Column | str) -> Column:
    """Quoted where it holds a quote, comma or line feed (not for a carriage return alone); empty for null."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Polish form for a number: 1; 2 to 4 but not 12 to 14; all others."""
    tens, units = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    return F.when(n == 1, one).when(units.between(2, 4) & ~tens.between(12, 14), few).otherwise(many)
