"""Personal data: regular expressions propose spans, checksum validators confirm them, context words adjust the score.

Base kinds are email, ip, card (Luhn) and phone; the method adds iban (mod-97) and ssn (which stands only near a context
word). Matches are leftmost and do not overlap within a kind; one that fails its validator is dropped and not tried again
from another start. A span is (kind, start, end, score): code points, end exclusive. Base spans that pass stay whatever their
score; added ones need THRESHOLD.

Places come from splitting the text at the pattern: running sums of the lengths of gaps and matches are the places, and
context words are looked for in the pieces next to a match, so a text with thousands of matches takes little more than its
length. The expressions begin only where a match could begin and repeat without recursion, so a long run of any characters
is read once and needs no stack. Everything is built-in functions on single rows: no shuffle, no Python.

Null texts count as empty and have no spans. Repeated rows give repeated results. An empty table gives an empty result.
Other columns of the input are kept; columns named like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Characters on either side in which a context word counts.
REACH = 40
THRESHOLD = 0.5

# What each kind looks like, its score when its validator passes, what a context word adds, and those words.
# (?:(?<!class)|\G) lets a match begin at a run's start or right behind the match before; from within a run none can succeed
# where the run's start fails.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this has no match, which spares most texts the search.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"-[0-9]{2}-"}
SCORES = {"email": (0.9, 0.1), "ip": (0.7, 0.2), "card": (0.8, 0.2), "phone": (0.7, 0.2), "iban": (0.9, 0.1), "ssn": (0.3, 0.5)}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "address|server|host|login|adresse|servidor",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|llamar",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}


def _ip(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _card(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _phone(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)


def _iban(match: Column) -> Column:
    """The first four characters go to the end, letters count 10 to 35, and the number leaves 1 divided by 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: (rest * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97
    chars = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.substring(moved, i, F.lit(1)))
    return F.length(plain).between(15, 34) & (F.aggregate(chars, F.lit(0), step) == 1)


def _ssn(match: Column) -> Column:
    return ~match.rlike("^(000|666|9)|-00-|-0000$")


VALID: dict[str, Callable[[Column], Column]] = {"email": lambda m: F.lit(True), "ip": _ip, "card": _card, "phone": _phone, "iban": _iban, "ssn": _ssn}

#: Matches on either side that can lie within REACH characters: none is shorter than five.
BESIDE = REACH // 5
#: Code points of the blocks from which redact() takes what lies between spans.
BLOCK = 4096


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: it is a lambda's variable there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The array whose i-th entry joins the entries up to i (sums, largest values): as many passes as the length has bits."""
    length = lambda v: F.size(v)

    def doubled(v: Column, k: Column) -> Column:
        back = F.expr("1").cast("int")
        return F.transform(v, lambda x, i: F.coalesce(join(x, F.get(v, i - F.call_function("shiftleft", back, k))), x))

    def of(v: Column) -> Column:
        steps = F.when(length(v) > 1, F.sequence(F.lit(0), F.ceil(F.log2(length(v))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, v, doubled)

    return bound(values, of)


def spans_of(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, score) of confirmed spans."""
    score, more = SCORES[kind]
    pattern = PATTERNS[kind]
    kept = "array<struct<kind:string,start:int,end:int,score:double>>"

    def scored(s: Column) -> Column:
        """s: matches m, gaps around them (one more than matches), ends of the matches."""

        def one(p: Column) -> Column:
            i = p["i"]
            before = F.transform(F.sequence(F.greatest(i - BESIDE, F.lit(0)), i), lambda j: F.concat(F.coalesce(F.get(s["m"], j - 1), F.lit("")), F.right(F.get(s["gap"], j), F.lit(REACH))))
            after = F.transform(F.sequence(i + 1, F.least(i + 1 + BESIDE, F.size(s["m"]))), lambda j: F.concat(F.left(F.get(s["gap"], j), F.lit(REACH)), F.coalesce(F.get(s["m"], j), F.lit(""))))
            around = F.lower(F.concat_ws(" ", F.right(F.array_join(before, ""), F.lit(REACH)), F.left(F.array_join(after, ""), F.lit(REACH))))
            value = F.when(around.rlike(CONTEXT[kind]), F.lit(min(score + more, 1.0))).otherwise(F.lit(score))
            end = F.get(s["end"], i)
            return F.struct(F.lit(kind).alias("kind"), (end - F.length(p["m"])).alias("start"), end.alias("end"), value.alias("score"))

        return F.transform(F.filter(F.transform(s["m"], lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda p: VALID[kind](p["m"])), one)

    def placed(s: Column) -> Column:
        sizes = F.transform(s["m"], lambda m, i: F.length(m) + F.length(F.get(s["gap"], i)))
        return bound(F.struct(s["m"].alias("m"), s["gap"].alias("gap"), running(sizes, lambda a, b: a + b).alias("end")), scored)

    matches = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))
    found = bound(matches, placed)
    if kind not in BASE:
        found = F.filter(found, lambda s: s["score"] >= THRESHOLD)
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(kept))


def find(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with one column pii_<kind> for each kind: array of (kind, start, end, score), by start."""
    text = "pii_text"
    out = docs.drop(*[f"pii_{k}" for k in KINDS]).withColumn(text, text_of(text_column))
    return out.withColumns({f"pii_{k}": spans_of(F.col(text), k) for k in KINDS}).drop(text)


def listed(kinds: tuple[str, ...]) -> Column:
    """`kind:start:end` of all spans of these kinds, by kind as listed, then by start, joined by commas."""
    spans = F.concat(*[F.col(f"pii_{k}") for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; of spans that overlap, the first names the whole.
    Null texts stay null. Other columns keep their values, whatever their names."""
    found = find(docs.select(F.struct("*").alias("document"), F.col(text_column).alias("body")), "body")
    spans = F.array_sort(F.concat(*[F.transform(f"pii_{k}", lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["kind"])) for k in KINDS]))
    text = F.col("body")

    def joined(s: Column) -> Column:
        """s: spans by start, the furthest end up to each, the text in blocks."""

        def between(start: Column, end: Column) -> Column:
            first = F.floor(start / BLOCK).cast("int")
            near = F.array_join(F.slice(s["block"], first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
            return F.substring(near, start - first * BLOCK + 1, end - start)

        def one(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(s["far"], i - 1), F.lit(0))
            return F.when(x["start"] >= before, F.concat(between(before, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))

        return F.concat(F.array_join(F.transform(s["span"], one), ""), between(F.element_at(s["far"], -1), s["n"]))

    def redacted(span: Column) -> Column:
        far = running(F.transform(span, lambda x: -x["back"]), lambda a, b: F.when(a >= b, a).when(a < b, b))
        return bound(F.struct(span.alias("span"), far.alias("far"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("block"), F.length(text).alias("n")), joined)

    found = found.withColumn("pii_spans", spans)
    new = F.when(F.size("pii_spans") > 0, bound(F.col("pii_spans"), redacted)).otherwise(text)
    own = lambda c: new if c.lower() == text_column.lower() else F.col(f"document.`{c}`")
    return found.select(*[own(c).alias(c) for c in docs.columns])
