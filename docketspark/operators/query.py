"""The search language: text to a syntax tree on the driver, the tree to one Column that Catalyst can push and fold.

    expression: terms with OR; terms: factors side by side or with AND; factor: NOT factor, ( expression ), field:value,
    "quoted text", word. NOT binds tighter than AND, AND tighter than OR; operators in any case.

Fields are those of dims.FIELDS, their names with or without accents. `art. 5` counts as one word.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import fold_plain, legal_plain, occurrences

LETTERS = "A-Za-ząćęłńóśźżĄĆĘŁŃÓŚŹŻ"


class QuerySyntaxError(ValueError):
    """The query cannot be read."""


@dataclass(frozen=True)
class Text:
    raw: str
    norm: str
    legal: str
    quoted: bool = False


@dataclass(frozen=True)
class Field:
    field: str
    raw: str
    values: tuple[str, ...] = ()
    years: tuple[int, int] | None = None


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Query:
    """A parsed query; texts are all its text operands, negated ones too, in order."""

    source: str
    tree: object | None
    texts: tuple[Text, ...] = ()

    def terms(self) -> list[str]:
        return list(dict.fromkeys(t.legal or t.norm for t in self.texts))


def sections_of(value: str) -> tuple[str, ...]:
    """Section keys that a query value names: by key, label or alias, by bundle, as a list with commas, or as a part of a key
    or label."""
    norm = fold_plain(value)
    if not norm:
        return ()
    exact = {fold_plain(k): k for k in dims.SECTIONS} | {fold_plain(v): k for k, v in dims.SECTIONS.items()} | dims.SECTION_ALIASES
    if norm in exact:
        return (exact[norm],)
    if norm in dims.SECTION_BUNDLES:
        return dims.SECTION_BUNDLES[norm]
    parts = [p.strip() for p in norm.split(",") if p.strip()]
    if len(parts) > 1:
        return tuple(dict.fromkeys(k for p in parts for k in sections_of(p)))
    return tuple(k for k, v in dims.SECTIONS.items() if norm in fold_plain(k) or norm in fold_plain(v))


def type_key(value: str) -> str | None:
    """A decision type by key, label or keyword."""
    norm = fold_plain(value)
    for k, v in dims.DECISION_TYPES.items():
        if norm in (fold_plain(k), fold_plain(v)):
            return k
    rules = [(("postanow", "tymczas"), "postanowienie_tymczasowe"), (("postanow",), "postanowienie"), (("rozstrzyg",), "rozstrzygniecie"), (("wyrok",), "wyrok")]
    return next((k for words, k in rules if norm and all(w in norm for w in words)), None)


def bench_key(value: str) -> str | None:
    norm = fold_plain(value)
    for k, v in dims.BENCHES.items():
        if norm in (fold_plain(k), fold_plain(v)):
            return k
    return next((k for part, k in (("peln", "pelny_sklad"), ("piecio", "piecioosobowa"), ("trojo", "trojosobowa")) if part in norm), None) if norm else None


def text_operand(value: str, quoted: bool = False) -> Text:
    raw = " ".join(value.split())
    norm = fold_plain(raw)
    if not norm:
        raise QuerySyntaxError("an empty text in the query")
    return Text(raw, norm, legal_plain(raw), quoted)


def field_operand(name: str, value: str) -> Field:
    raw = " ".join(value.split())
    if not raw:
        raise QuerySyntaxError(f"no value for {name}")
    if name == "year":
        found = re.fullmatch(r"(\d{4})(?:\s*-\s*(\d{4}))?", raw, re.ASCII)
        if not found:
            raise QuerySyntaxError("rok: takes a year or two of them, as in rok:2020-2025")
        years = sorted(int(y) for y in (found[1], found[2] or found[1]))
        return Field(name, raw, years=(years[0], years[1]))
    if name == "section":
        keys = sections_of(raw)
        if not keys:
            raise QuerySyntaxError(f"no section is named {raw}")
        return Field(name, raw, keys)
    if name == "decision_type":
        key = type_key(raw)
        names = [dims.DECISION_TYPES[key], key] if key else []
        return Field(name, raw, tuple(dict.fromkeys(fold_plain(x) for x in [*names, raw.replace("_", " ")] if fold_plain(x))))
    return Field(name, raw, (fold_plain(raw),))


_TOKEN = re.compile(rf'\s*(?:(?P<paren>[()])|(?P<field>[{LETTERS}]+):\s*|(?P<quote>")|(?P<word>[^\s()]+))')
_REST = re.compile(r'((?:[^"\\]|\\"|\\)*?)"')


def _quoted(source: str, at: int) -> tuple[str, int]:
    found = _REST.match(source, at)
    if not found:
        raise QuerySyntaxError("a quotation mark is not closed")
    return found[1].replace('\\"', '"'), found.end()


def lex(source: str) -> list[object]:
    """Operands and the strings ( ) AND OR NOT."""
    out: list[object] = []
    at = 0
    while found := _TOKEN.match(source, at):
        at = found.end()
        if found["paren"]:
            out.append(found["paren"])
        elif found["field"]:
            name = dims.FIELDS.get(fold_plain(found["field"]))
            if not name:
                raise QuerySyntaxError(f"there is no field {found['field']}:")
            if at >= len(source):
                raise QuerySyntaxError(f"no value for {found['field']}:")
            if source[at] == '"':
                value, at = _quoted(source, at + 1)
            else:
                bare = re.compile(r"[^\s()]*").match(source, at)
                value, at = bare[0], bare.end()
            out.append(field_operand(name, value))
        elif found["quote"]:
            value, at = _quoted(source, at)
            out.append(text_operand(value, True))
        elif found["word"].upper() in ("AND", "OR", "NOT"):
            out.append(found["word"].upper())
        elif ":" in found["word"]:
            raise QuerySyntaxError(f"there is no field {found['word'].split(':')[0]}:")
        else:
            out.append(text_operand(found["word"]))
    return out


class _Parser:
    def __init__(self, tokens: list[object]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> object:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> object:
        token = self.peek()
        self.at += 1
        return token

    def either(self) -> object:
        left = self.both()
        while self.peek() == "OR":
            self.take()
            left = Either(left, self.both())
        return left

    def both(self) -> object:
        left = self.factor()
        while self.peek() not in (None, "OR", ")"):
            if self.peek() == "AND":
                self.take()
            left = Both(left, self.factor())
        return left

    def factor(self) -> object:
        token = self.take()
        if token == "NOT":
            return Not(self.factor())
        if token == "(":
            inner = self.either()
            if self.take() != ")":
                raise QuerySyntaxError("a parenthesis is not closed")
            return inner
        if isinstance(token, (Text, Field)):
            return token
        raise QuerySyntaxError("an operand is missing" if token is None else f"{token} stands where an operand should")


def parse(source: str) -> Query:
    """The query, or QuerySyntaxError. An empty one has no tree: it matches everything (browsing)."""
    text = " ".join((source or "").replace(" ", " ").split())
    if not text:
        return Query(source, None)
    text = re.sub(r"(?<![\w])(art)\.?\s+(\d+[a-z]?)", r"\1\2", text, flags=re.IGNORECASE | re.ASCII)
    tokens = lex(text)
    parser = _Parser(tokens)
    tree = parser.either()
    if parser.peek() is not None:
        raise QuerySyntaxError("a parenthesis is not opened")
    return Query(source, tree, tuple(t for t in tokens if isinstance(t, Text)))


def merged(*queries: Query) -> Query:
    """The text operands of several queries, for highlighting."""
    return Query(" ".join(q.source for q in queries), None, tuple(dict.fromkeys(t for q in queries for t in q.texts)))


@dataclass(frozen=True)
class Fields:
    """Which columns of an index hold what."""

    text: str = "text_legal"
    section: str = "section_key"
    signature: str = "case_signature_norm"
    judges: str = "judge_norm"
    type: str = "decision_type_norm"
    thesis: str = "topic_norm"
    year: str = "year"


def matches_text(t: Text, text: Column) -> Column:
    found = text.contains(t.norm)
    return found if t.legal in ("", t.norm) else found | text.contains(t.legal)


def matches_field(f: Field, at: Fields) -> Column:
    any_of = lambda c: reduce(lambda a, b: a | b, [c.contains(v) for v in f.values])
    if f.field == "year":
        found = F.col(at.year).between(*f.years)
    elif f.field == "section":
        found = F.col(at.section).isin(*f.values)
    elif f.field == "judge":
        found = F.exists(at.judges, lambda j: j.contains(f.values[0]))
    else:
        found = any_of(F.col({"signature": at.signature, "decision_type": at.type, "thesis": at.thesis}[f.field]))
    return F.coalesce(found, F.lit(False))


def condition(query: Query, at: Fields = Fields(), text: Callable[[Text], Column] | None = None) -> Column:
    """One boolean Column, never null. text: another test of a text operand (by lemma, say)."""
    of_text = text or (lambda t: F.coalesce(matches_text(t, F.col(at.text)), F.lit(False)))

    def build(node: object) -> Column:
        match node:
            case Text():
                return of_text(node)
            case Field():
                return matches_field(node, at)
            case Not():
                return ~build(node.part)
            case Both():
                return build(node.left) & build(node.right)
            case Either():
                return build(node.left) | build(node.right)
        raise TypeError(node)

    return F.lit(True) if query.tree is None else build(query.tree)


def score(query: Query, at: Fields = Fields()) -> Column:
    """Occurrences of all text operands (1 at least) times the section's weight, and a bonus for each quoted one that is
    there; the section's weight alone without text operands. 3 decimals."""
    from ..functions.scalars import one_of

    weight = one_of(F.col(at.section), dims.SEARCH_WEIGHTS, 1.0)
    if not query.texts:
        return weight
    counts = [occurrences(F.col(at.text), t.legal or t.norm) for t in query.texts]
    tf = reduce(lambda a, b: a + b, counts)
    bonus = reduce(lambda a, b: a + b, [F.when(c > 0, dims.PHRASE_BONUS).otherwise(0.0) for c, t in zip(counts, query.texts) if t.quoted] or [F.lit(0.0)])
    return F.round(F.greatest(tf, F.lit(1)) * weight + bonus, 3)


@dataclass(frozen=True)
class Filters:
    """Facets: all that are given have to hold."""

    sections: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    benches: tuple[str, ...] = ()
    year_from: int | None = None
    year_to: int | None = None
    judge: str = ""
    signature: str = ""
    standard: str = ""

    @staticmethod
    def preset(name: str) -> Filters:
        sections, types = dims.PRESETS[name]
        return Filters(sections=sections, types=types)

    def condition(self, at: Fields = Fields(), type_key: str = "decision_type_ipo_key", bench: str = "bench_size_ipo_key", standard: str = "standard_norm") -> Column:
        tests = []
        if self.types:
            tests.append(F.col(type_key).isin(*self.types))
        if self.year_from is not None:
            tests.append(F.col(at.year) >= self.year_from)
        if self.year_to is not None:
            tests.append(F.col(at.year) <= self.year_to)
        if self.judge:
            tests.append(F.exists(at.judges, lambda j: j.contains(fold_plain(self.judge))))
        if self.signature:
            tests.append(F.col(at.signature).contains(fold_plain(self.signature)))
        if self.benches:
            tests.append(F.col(bench).isin(*self.benches) & F.col(bench).isin(*dims.BENCHES))
        if self.standard:
            tests.append(F.col(standard).contains(fold_plain(self.standard)))
        if self.sections:
            tests.append(F.col(at.section).isin(*self.sections))
        return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


@dataclass(frozen=True)
class SearchRequest:
    """A query with its facets, to and from URL parameters."""

    query: str = ""
    filters: Filters = field(default_factory=Filters)
    lemma: bool = False
    page: int = 1

    @staticmethod
    def from_params(params: dict[str, str]) -> SearchRequest:
        listed = lambda k: tuple(x for x in params.get(k, "").split(",") if x)
        year = lambda k: int(params[k]) if re.fullmatch(r"\d{4}", params.get(k, "")) else None
        filters = Filters(listed("sections"), listed("types"), listed("benches"), year("year_from"), year("year_to"), params.get("judge", ""), params.get("signature", ""), params.get("wzorzec", ""))
        return SearchRequest(params.get("q", ""), filters, params.get("lemma") == "1")

    def to_params(self) -> dict[str, str]:
        f = self.filters
        out = {"q": self.query, "sections": ",".join(f.sections), "types": ",".join(f.types), "benches": ",".join(f.benches), "year_from": str(f.year_from or ""), "year_to": str(f.year_to or ""), "judge": f.judge, "signature": f.signature, "wzorzec": f.standard, "lemma": "1" if self.lemma else ""}
        return {k: v for k, v in out.items() if v}
