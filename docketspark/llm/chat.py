"""Chat formatting: rows of any known layout become canonical turns, and turns become training text with a loss mask.

A layout is told by a fingerprint: the SHA-256 of the sorted paths and types of nested fields. MAPPINGS has the fingerprints of
known layouts, each with a declarative mapping to canonical turns (conv_id, turn, role, text): a projection, and an array to
unfold where one row holds several turns. A table's schema names the layouts that its rows can have; where there are several,
each row's own fingerprint, of the paths that it fills, selects its mapping (see chosen()). Other columns do no harm.

Template: a turn is `### role:` and a line feed, the text, a line feed and `</turn>` and a line feed. In roles and texts a
backslash is put before every backslash, `###` and `</turn>`; in roles line feeds become `\\n` and colons `\\:`. So a marker
that stands without a backslash is the template's, and taking the backslashes away gives the text back. Each turn is a row
of the output (a conversation is its turns' pieces, one after the other), so no conversation has to fit in one row here.
The loss mask covers the text of assistant turns.

DataFrame functions only. Null texts and roles count as empty. Turns with equal numbers are ordered by role, then text.
Repeated turns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "\n</turn>\n"


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """`path:type` of all leaves; [] stands for an array's elements. Integer widths are one type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [f"{at}:{'long' if isinstance(kind, T.IntegralType) else kind.simpleString()}"]


def fingerprint(found: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """fields: the layout's paths. turns: (turn, role, text) structs in an array, from the columns. ids: conv_id."""

    name: str
    fields: tuple[str, ...]
    turns: Callable[[], Column]
    ids: Callable[[], Column] = field(default=lambda: F.col("conv_id"))


def _turn(number: Column | int, role: Column | str, text: Column | str) -> Column:
    as_column = lambda x, make: x if isinstance(x, Column) else make(x)
    return F.struct(as_column(number, F.lit).cast("long").alias("turn"), as_column(role, F.lit).cast("string").alias("role"), as_column(text, F.col).alias("text"))


def _unfold(array: str, role: str, text: str, names: dict[str, str] | None = None) -> Column:
    """The turns of an array of messages; names maps the layout's roles to canonical ones."""

    def one(m: Column, i: Column) -> Column:
        value = m[role]
        for old, new in (names or {}).items():
            value = F.when(value == old, F.lit(new)).otherwise(value)
        return _turn(i, value, m[text])

    return F.transform(F.coalesce(array, F.array()), one)


MAPPINGS = {
    fingerprint(list(m.fields)): m
    for m in (
        Mapping("turn rows", ("conv_id:long", "turn:long", "role:string", "text:string"), lambda: F.array(_turn(F.col("turn"), F.col("role"), "text"))),
        Mapping("messages", ("conv_id:long", "messages[].role:string", "messages[].content:string"), lambda: _unfold("messages", "role", "content")),
        Mapping("from/value", ("conv_id:long", "conversations[].from:string", "conversations[].value:string"), lambda: _unfold("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
        Mapping("prompt/response", ("conv_id:long", "prompt:string", "response:string"), lambda: F.array(_turn(0, "user", "prompt"), _turn(1, "assistant", "response"))),
        Mapping(
            "instruction/input/output",
            ("conv_id:long", "instruction:string", "input:string", "output:string"),
            lambda: F.array(_turn(0, "user", F.when(F.coalesce("input", F.lit("")) == "", F.col("instruction")).otherwise(F.concat_ws("\n\n", "instruction", "input"))), _turn(1, "assistant", "output")),
        ),
        Mapping("instruction/output", ("conv_id:long", "instruction:string", "output:string"), lambda: F.array(_turn(0, "user", "instruction"), _turn(1, "assistant", "output"))),
    )
}


def layouts_of(schema: T.StructType) -> list[Mapping]:
    """The known layouts whose paths a schema has, larger ones first; the one that its whole fingerprint names alone if known."""
    found = paths(schema)
    if (known := MAPPINGS.get(fingerprint(found))) is not None and len(known.fields) == len(found):
        inner = [m for m in MAPPINGS.values() if set(m.fields) < set(known.fields)]
        return [known, *inner]
    out = [m for m in sorted(MAPPINGS.values(), key=lambda m: -len(m.fields)) if fingerprint([p for p in found if p in m.fields]) == fingerprint(list(m.fields))]
    if not out:
        raise ValueError(f"no mapping for a table with {', '.join(sorted(found))}")
    return out


def top(path: str) -> str:
    """The column that a path begins with."""
    return path.split(":")[0].split("[")[0].split(".")[0]


def chosen(layouts: list[Mapping]) -> Column:
    """The number of a row's layout: the one whose fingerprint is that of the paths that the row fills; else the largest that
    the row fills wholly (of equals the one listed first); else the one of which it fills most; null if it fills nothing of any."""
    columns: dict[str, set[str]] = {}
    for m in layouts:
        for p in m.fields:
            columns.setdefault(top(p), set()).add(p)
    own = lambda m: sorted({top(p) for p in m.fields} - {"conv_id"})
    none = F.array().cast("array<string>")
    filled = [F.array(*map(F.lit, sorted(ps))) if c == "conv_id" else F.when(F.col(c).isNotNull(), F.array(*map(F.lit, sorted(ps)))).otherwise(none) for c, ps in columns.items()]
    print_ = F.sha2(F.array_join(F.array_sort(F.flatten(F.array(*filled))), "\n"), 256)
    share = lambda m: sum((F.col(c).isNotNull().cast("int") for c in own(m)), F.lit(0))
    rules = [(print_ == fingerprint(list(m.fields)), i) for i, m in enumerate(layouts)]
    rules += [(share(m) == len(own(m)), i) for i, m in enumerate(layouts)]
    most = F.greatest(*[share(m) for m in layouts]) if len(layouts) > 1 else share(layouts[0])
    rules += [((share(m) == most) & (most > 0), i) for i, m in enumerate(layouts)]
    out = F
    for test, i in rules:
        out = out.when(test, F.lit(i))
    return out


def canonical(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table in any known layouts. A row without turns gives one that has no number, role or
    text, so no conversation is lost."""
    layouts = layouts_of(rows.schema)
    if len(layouts) == 1:
        turns = layouts[0].turns()
    else:
        turns = F
        for i, m in enumerate(layouts):
            turns = turns.when(F.col("chat_layout") == i, m.turns())
        rows = rows.withColumn("chat_layout", chosen(layouts))
    out = rows.select(layouts[0].ids().cast("long").alias("conv_id"), F.inline_outer(turns))
    return out.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _swap(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _swap(text, ("\\", "\\\\"), ("###", "\\###"), ("</turn>", "\\</turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|###|</turn>)", "$1")


def escape_role(role: Column) -> Column:
    return _swap(escape(role), (":", "\\:"), ("\n", "\\n"))


def unescape_role(role: Column) -> Column:
    """Backslash pairs are set aside first, so that what is left of `\\n` is a line feed's."""
    plain = lambda s: F.regexp_replace(F.replace(s, F.lit("\\n"), F.lit("\n")), r"\\(###|</turn>|:)", "$1")
    return F.array_join(F.transform(F.split(role, r"\\\\"), plain), "\\")


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, piece, loss_start, loss_length: the formatted text of each turn and the part of it that the loss
    is taken over (null for none). rows: a table in any known layout."""
    turns = canonical(rows)
    head = F.concat(F.lit("### "), escape_role(F.col("role")), F.lit(":\n"))
    body = escape(F.col("text"))
    on = F.col("role") == "assistant"
    return turns.select("conv_id", "turn", "role", F.concat(head, body, F.lit(END)).alias("piece"), F.when(on, F.length(head)).alias("loss_start"), F.when(on, F.length(body)).alias("loss_length"))


def read_role(piece: Column) -> Column:
    head = F.substring_index(piece, "\n", 1)
    return unescape_role(F.substring(head, F.lit(5), F.length(head) - 5))


def read_text(piece: Column) -> Column:
    start = F.length(F.substring_index(piece, "\n", 1)) + 1
    return unescape(F.substring(piece, start + 1, F.length(piece) - start - len(END)))


def read_loss(piece: Column, start: Column, length: Column) -> Column:
    """The unescaped text under the mask."""
    return unescape(F.substring(piece, start + 1, length))
