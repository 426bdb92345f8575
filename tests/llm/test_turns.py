"""Conversation repair against SQL, and against trying all edits of small conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from docketspark.llm import registry, turns
from tests.oracle import duck, spark_rows

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def judged(rows):
    """The fault of each row (turn, role, text), in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, turns) over all edit sequences with at most n + 4 insertions."""
    faults, best = judged(rows), None

    def go(i, written, cost, audit, inserted):
        nonlocal best
        if best and (cost, audit) > best[:2] and cost > best[0]:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in written)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, list(written))
        else:
            _, role, text = rows[i]
            more = 3 if faults[i] == "truncated" else 0
            if faults[i] not in ("blank", "duplicate"):
                go(i + 1, [*written, (role, text)], cost + more, audit + "K", inserted)
                for other in ("user", "assistant"):
                    go(i + 1, [*written, (other, text)], cost + more + 3, audit + "R", inserted)
            go(i + 1, written, cost + 4, audit + "D", inserted)
        if inserted < 3:
            for other in ("user", "assistant"):
                go(i, [*written, (other, "")], cost + 3, audit + "I", inserted + 1)

    go(0, [], 0, "", 0)
    return best


def random_rows(rng, n):
    return [(t, rng.choice(["user", "assistant", "system", "tool", "", "u2"]), rng.choice(["", " \n", "a.", "b", "c!", "c! ", "é?", "x y"])) for t in sorted(rng.randint(0, 3) for _ in range(n))]


@pytest.mark.parametrize("seed", range(12))
def test_search_equals_all_edit_sequences(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 3, 4):
        rows = sorted(random_rows(rng, n))
        cost, audit, written = brute(rows)
        [(found, text)] = turns.cheapest([(r[:1], f) for (_, r, _), f in zip(rows, judged(rows))]).values()
        assert (found, text) == (cost, audit)
        assert [(t["role"], t["text"]) for t in turns.edited([r[1] for r in rows], [r[2] for r in rows], turns.START, audit)] == written


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_segments_combine_to_the_whole_search(size):
    rng = random.Random(size)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(1, 12))
        known = [(r[1][:1], f) for r, f in zip(rows, judged(rows))]
        [whole] = turns.cheapest(known).values()
        tables = [[{"entry": e, "exit": x, "cost": c, "audit": a} for e in range(4) for x, (c, a) in turns.cheapest(known[i : i + size], e, None).items()] for i in range(0, len(known), size)]
        cost, audit, chosen = turns.chained(tables)
        assert (cost, audit) == whole and "".join(a for _, a in chosen) == audit


def plain(rows):
    """The contract in plain Python: {conv_id: columns} of undamaged rows (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in out.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        f, ts, ini = judged(own), {r[0] for r in own} - {None}, [r[1][:1] for r in own]
        [(cost, audit)] = turns.cheapest(list(zip(ini, f))).values()
        done = turns.edited([r[1] for r in own], [r[2] for r in own], turns.START, audit)
        text = "\n".join(f"{t['role']}:{t['text']}" for t in done)
        out[conv] = (max(ts) - min(ts) + 1 - len(ts) if ts else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"), turns.legal_pairs(ini), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def query_of(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id long, turn long, role string, text string, part int, audit string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in registry.op13_turn_repair(spark, str(tmp_path)).collect()}


def test_query_on_odd_rows_and_a_large_conversation(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t if rng.random() < 0.9 else None, *r[1:]) for c in range(80) for t, r in enumerate(random_rows(rng, rng.randint(1, 9)))]
    rows += [(None, 1, None, None), (None, 2, "user", "Hi."), (5, None, "user", None), (-3, 4, "assistant", "x" * 200_000)]
    rows += [(500, t, rng.choice(["user", "assistant"]), rng.choice(["same.", f"text {t}.", f"cut {t}", ""])) for t in range(1500)]  # several segments
    rows += [(501, 1, "user", "again.")] * 700
    assert query_of(spark, tmp_path, rows) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert query_of(spark, tmp_path, []) == {}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf):
    assert spark_rows(registry.op13_turn_repair(spark, sf)) == duck(registry.ORACLES["op13_turn_repair"], sf)


def test_no_audit_of_a_node_starts_another(spark):
    """Equal costs at a node never have one audit as the start of the other: what the search's order rests on."""
    rng = random.Random(9)
    for _ in range(200):
        known = [(rng.choice("usax"), rng.choice(["", "blank", "truncated", "duplicate"])) for _ in range(4)]
        ends = turns.cheapest(known, turns.START, None)
        for (c1, a1), (c2, a2) in itertools.combinations(ends.values(), 2):
            assert c1 != c2 or not (a1.startswith(a2) or a2.startswith(a1))
