"""Repairing the structure of conversations: the cheapest edits that give turns of the form (system? (user assistant)+)?.

Dijkstra's search runs on the implicit edit lattice: a node is (rows consumed, grammar state), its priority key is (cost, audit),
where the audit is the edits' initials, and the search stops at the first accepting end node that it takes from the queue. No
audit at a node is the start of another with the same cost (the letters fix which rows they consume and what they cost), so
appending edits keeps their order and the first visit of a node is its best.

Rows come range-partitioned by conversation and turn and are sorted there. A conversation that lies inside one partition and has
at most SEGMENT rows is one search. Any other (a partition's first and last, or a long one) is cut into segments; each is searched
from every state it may be entered with, which gives a table of (entry, exit, cost, audit), and the tables of a conversation are
combined in order, as a shortest path over (segment, state). So no task holds the rows of a large conversation, and what is
gathered of it are its segments' audits: sixteen letters a row at most. Identical rows meet before they are sorted, as one with a count.

Nulls in role and text are one space. A null conv_id is a conversation of its own; null turns come first, like the smallest
turn. Rows of one turn are taken by role, then text. An empty role has no initial and cannot be kept as it is. Empty and very long
texts are rows like any other. An empty table gives an
empty result; a conversation without rows is not in the result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

#: States: nothing written, a system turn, a user turn last, an assistant turn last. What a turn's initial leads to.
START, SYSTEM, USER, DONE = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": DONE}, {"u": USER})
ACCEPTING = (START, DONE)
NAMES = {"u": "user", "a": "assistant"}
#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a segment at most.
SEGMENT = 256
#: A null turn is taken as this one.
FIRST = -(1 << 63)

SPACE = r"\x20\x09-\x0D"
SEGMENTS = "conv_id long, part int, seg long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, paths array<struct<entry: int, exit: int, cost: long, audit: string>>, roles array<string>, texts array<string>"


def open_role(state: int) -> str:
    """The initial (u or a) that an inserted or renamed turn has in this state."""
    return "a" if state == USER else "u"


def cheapest(rows: list[tuple[str, str]], entry: int = START, ends: tuple[int, ...] | None = ACCEPTING) -> dict[int, tuple[int, str]]:
    """{state: (cost, audit)} over rows (initial, fault), fault being blank, duplicate, truncated or empty.

    With ends: that of the first end node among them that is reached. Without: that of every end node."""
    heap, seen, found = [(0, "", 0, entry)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows):
            if ends is None:
                found[state] = (cost, audit)
            elif state in ends:
                return {state: (cost, audit)}
        else:
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault == "truncated" else 0
                if initial in NEXT[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state][initial]))
                heapq.heappush(heap, (cost + more + REROLE, audit + "R", i + 1, NEXT[state][open_role(state)]))
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, NEXT[state][open_role(state)]))
    return found


def edited(roles: list[str], texts: list[str], entry: int, audit: str) -> list[dict]:
    """The turns (role, text, edit) that these edits of the rows leave."""
    out, state, rows = [], entry, iter(zip(roles, texts))
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = NAMES[open_role(state)]
        state = NEXT[state][role[:1]]
        out.append({"role": role, "text": text, "edit": edit})
    return out


def legal_pairs(initials: list[str]) -> int:
    """How many neighbours are none of su, ua, au."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(" "))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, at (turn), role, text, n (identical rows), fault (of the first of them)."""
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("at"), filled("role").alias("role"), filled("text").alias("text"))
    own = own.groupBy("conv_id", "at", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("said", F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("\n"), F.sha2("role", 256), F.lit("\n"), "text"), 256))
    first = own.groupBy("said").agg(F.min("at").alias("first"))
    last = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    fault = F.when(last == "", "blank").when(F.col("at") > F.col("first"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return own.join(first, "said").select("conv_id", "at", "role", "text", "n", fault.alias("fault"))


def segments(rows: DataFrame) -> DataFrame:
    """SEGMENTS: the conversations cut into segments, in the order of (part, seg), with their cheapest paths."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for conv, role, text, n, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "n", "fault"))):
                yield conv, role, text, fault
                for _ in range(n - 1):
                    yield conv, role, text, "blank" if fault == "blank" else "duplicate"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, held = TaskContext.get().partitionId(), 0, []

        def row(run: list[tuple], inside: bool) -> dict:
            nonlocal seg
            seg += 1
            known = [(role[:1], fault) for _, role, _, fault in run]
            entries = [START] if inside else range(4)
            paths = [{"entry": e, "exit": x, "cost": c, "audit": a} for e in entries for x, (c, a) in cheapest(known, e, ACCEPTING if inside else None).items()]
            count = lambda kind: sum(f == kind for _, f in known)
            initials = [i for i, _ in known]
            return {"conv_id": run[0][0], "part": part, "seg": seg, "n": len(run), "blank": count("blank"), "duplicate": count("duplicate"), "truncated": count("truncated"), "illegal": legal_pairs(initials), "first": initials[0], "last": initials[-1], "paths": paths, "roles": [x[1] for x in run], "texts": [x[2] for x in run]}

        def pieces(run: Iterator[tuple]) -> Iterator[list[tuple]]:
            piece = []
            for unit in run:
                if len(piece) == SEGMENT:
                    yield piece
                    piece = []
                piece.append(unit)
            yield piece

        size, schema, pending = 0, pa_schema(), None
        for number, (_, run) in enumerate(groupby(units(batches), lambda x: x[0])):
            for k, piece in enumerate(pieces(run)):
                if pending:  # inside: all of a run that neither opens nor closes the partition
                    before, place, its_run = pending
                    held.append(row(before, its_run > 0 and place == 0 and k == 0))
                pending = (piece, k, number)
                size += sum(len(x[2]) for x in piece)
                if held and (len(held) >= 1000 or size > 4_000_000):
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if pending:
            held.append(row(pending[0], False))
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    keys = ["conv_id", "at", "role", "text"]
    dealt = faults(rows).repartitionByRange(partitions(rows.sparkSession), *keys[:3], F.substring("text", 1, 64)).sortWithinPartitions(*keys)
    return stored(dealt.select(*keys, "n", "fault").mapInArrow(cut, SEGMENTS), "turns")


def pa_schema() -> pa.Schema:
    path = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    longs = [(c, pa.int64()) for c in ("seg", "n", "blank", "duplicate", "truncated", "illegal")]
    return pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), *longs, ("first", pa.string()), ("last", pa.string()), ("paths", pa.list_(path)), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def chained(tables: list[list[dict]]) -> tuple[int, str, list[tuple[int, str]]]:
    """(cost, audit, [(entry, audit) of each segment]): the cheapest way through segments' paths to an accepting state."""
    best: dict[int, tuple] = {START: (0, "", None)}
    for paths in tables:
        ways: dict[int, tuple] = {}
        for p in paths:
            if p["entry"] in best:
                cost, audit, before = best[p["entry"]]
                way = (cost + p["cost"], audit + p["audit"], (before, p["entry"], p["audit"]))
                if p["exit"] not in ways or way[:2] < ways[p["exit"]][:2]:
                    ways[p["exit"]] = way
        best = ways
    cost, audit, link = min((best[s] for s in ACCEPTING if s in best), key=lambda x: x[:2])
    chosen = []
    while link:
        link, entry, part = link
        chosen.append((entry, part))
    return cost, audit, chosen[::-1]


def decided(cut: DataFrame) -> DataFrame:
    """conv_id, cost, audit, illegal, chosen (part, seg, entry, edits): one row for each conversation of segments()."""
    one = F.struct("part", "seg", "first", "last", "illegal", "paths")
    gathered = cut.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("segs"))
    schema = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("chosen", pa.list_(pa.struct([("part", pa.int32()), ("seg", pa.int64()), ("entry", pa.int32()), ("edits", pa.string())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, segs in zip(*(c.to_pylist() for c in batch.columns)):
                cost, audit, ways = chained([s["paths"] for s in segs])
                illegal = sum(s["illegal"] for s in segs) + sum(legal_pairs([a["last"], b["first"]]) for a, b in zip(segs, segs[1:]))
                chosen = [{"part": s["part"], "seg": s["seg"], "entry": e, "edits": a} for s, (e, a) in zip(segs, ways)]
                out.append({"conv_id": conv, "cost": cost, "audit": audit, "illegal": illegal, "chosen": chosen})
            yield pa.RecordBatch.from_pylist(out, schema)

    return gathered.mapInArrow(work, "conv_id long, cost long, audit string, illegal long, chosen array<struct<part: int, seg: long, entry: int, edits: string>>")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, turns). report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, one row for each conversation.
    turns: conv_id, part, seg, turns (role, text, edit): the repaired turns, in the order of (part, seg)."""
    cut = segments(rows)
    ways = stored(decided(cut), "repairs")
    counts = cut.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    seen = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).distinct()
    gaps = seen.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    same = lambda a, b: a.conv_id.eqNullSafe(b.conv_id)
    report = ways.join(counts, same(ways, counts)).join(gaps, same(ways, gaps)).select(ways.conv_id, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    chosen = ways.select(F.inline("chosen"))
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int64()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "part": r["part"], "seg": r["seg"], "turns": edited(r["roles"], r["texts"], r["entry"], r["edits"])} for r in rows], schema)

    planned = cut.join(chosen, ["part", "seg"]).select("conv_id", "part", "seg", "roles", "texts", "entry", "edits")
    return report, planned.mapInArrow(apply, "conv_id long, part int, seg long, turns array<struct<role: string, text: string, edit: string>>")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 (of role:text of all turns, joined by line feeds). A conversation's segments stream through its hash in
    order, so none is held whole."""
    schema = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segs = (r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        out = []
        for conv, run in groupby(segs, lambda r: r[0]):
            h, any_ = hashlib.sha256(), False
            for _, written in run:
                for t in written:
                    h.update((("\n" if any_ else "") + f"{t['role']}:{t['text']}").encode())
                    any_ = True
            out.append({"conv_id": conv, "sha256": h.hexdigest()})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    dealt = turns.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "seg")
    return dealt.select("conv_id", "turns").mapInArrow(work, "conv_id long, sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """The rows damaged by crc32(conv_id:turn) % 20: 0 is dropped, 1 emptied, 2 loses its full stops, 3 is repeated, 4 becomes a
    user's. Nulls are one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    role = F.when(kind == 4, "user").otherwise(filled("role"))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
