"""Personal data, exact duplicates and chat formatting against plain Python and DuckDB."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from docketspark.llm import chat, exact_dedup, pii
from docketspark.llm.registry import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_base(t):
    """Fixed patterns of the contract, as they stand there."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if ok(m[0])] for k, p, ok in rules}


def noisy(rng):
    bits = ["a@b.cc", "x.y+z@m-n.co.uk", "@", "a@", "@b.c", "_d@e.f", ".", "..", "1.2.3.4", "256.1.1.1", "010.000000255.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4041894974608795", "+1 (389) 555-5010", "+49 30 1234567", "+1", "+12345678901234567890", " ", "é", "😀", "\n", "-", "12", "7", "%", "A", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789", "card"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(11)
    rows = [(i, noisy(rng)) for i in range(1500)] + [(2000, None), (2001, ""), (2002, "x" * 80_000 + "@"), (2003, "1" * 60_000 + ".2"), (2004, "a@b.cc " * 1500), (3, "same id 1.2.3.4"), (None, "no id +49 30 1234567")]
    rows += [(5000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, pii_ip int, pii_text string")
    out = pii.find(df)
    got = sorted(((r.doc_id is None, r.doc_id or 0), [r[f"l_{k}"] for k in pii.BASE]) for r in out.select("doc_id", *[pii.listed((k,)).alias(f"l_{k}") for k in pii.BASE]).collect())
    want = sorted(((i is None, i or 0), [",".join(x) for x in plain_base(t or "").values()]) for i, t in rows)
    assert got == want
    assert pii.find(df.limit(0)).count() == 0


def test_added_kinds_and_scores(spark):
    df = spark.createDataFrame([(1, "my iban is GB82 WEST 1234 5698 7654 32, thanks"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "social security 123-45-6789"), (4, "part 123-45-6789"), (5, "mail me: a@b.cc"), (6, "a@b.cc")], "doc_id int, text string")
    out = {r.doc_id: r for r in pii.find(df).collect()}
    assert [(s.start, s.end) for s in out[1].pii_iban] == [(11, 38)] and out[2].pii_iban == []
    assert [(s.start, s.end) for s in out[3].pii_ssn] == [(16, 27)] and out[4].pii_ssn == []
    assert out[5].pii_email[0].score > out[6].pii_email[0].score


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.cc and +49 30 1234567!"), (2, None), (3, "nothing"), (4, "+4111111111111111 x")], "doc_id int, text string")
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out == {1: "é [EMAIL] and [PHONE]!", 2: None, 3: "nothing", 4: "+[CARD] x"}


N = 10**6
#: Runs that fit a pattern or nearly do, of every class of characters that the patterns know.
LONG = ["a@b" + ".c" * N, "a" * N, "a@" * N, "." * N, "1" * N, "1." * N, "+1 " * N, "+1" + " " * N, "-" * N, "GB82 " * N, "+1(" + "(" * N, "1 " * N, "é" * N, "\n" * N, "%" * N, "123-45-" * N, "A1" * N]


def test_long_runs_need_no_stack(spark):
    df = spark.createDataFrame(list(enumerate(t[:N] if i else t for i, t in enumerate(LONG))), "doc_id long, text string").repartition(4)
    out = pii.find(df).select("doc_id", *[F.size(f"pii_{k}").alias(k) for k in pii.KINDS]).collect()
    assert {r.doc_id: r.email for r in out if r.email} == {0: 1} and {r.doc_id: r.ip for r in out if r.ip} == {5: N // 8}
    assert len(pii.redact(df).select("doc_id", F.length("text")).collect()) == len(LONG)


def test_thousands_of_matches_in_one_text(spark):
    t = "é mail a@b.cc +49 30 1234567, 1.2.3.4;" * 10_000
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    assert pii.find(df).select(pii.listed(pii.BASE)).first()[0] == ",".join(x for k in plain_base(t).values() for x in k)
    assert pii.redact(df).first().text == "é mail [EMAIL] [PHONE], [IP];" * 10_000


def test_context_is_the_text_around(spark):
    rng = random.Random(4)
    bits = ["a@b.cc", "mail", "1.2.3.4", "server", " ", "x" * 17, "é" * 11, "host", "a@b.cc\n", "x@y.zz"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))) for i in range(300)]
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        for k in ("email", "ip"):
            for x in r[f"pii_{k}"]:
                around = (r.text[max(0, x.start - pii.REACH) : x.start] + " " + r.text[x.end : x.end + pii.REACH]).lower()
                assert (x.score > pii.SCORES[k][0]) == bool(re.search(pii.CONTEXT[k], around))


def test_redaction_of_blocks(spark):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        t = noisy(rng) + "".join(rng.choice(["é", "😀", "word ", "a@b.cc ", "4111 1111 1111 1111 ", "+49 30 1234567 "]) for _ in range(rng.randint(0, 4000)))
        rows.append((i, t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: sorted((x.start, -x.end, k) for k in pii.KINDS for x in r[f"pii_{k}"]) for r in pii.find(df).collect()}
    for r in pii.redact(df).collect():
        t, out, at = rows[r.doc_id][1], "", 0
        for start, end, kind in spans[r.doc_id]:
            if start >= at:
                out += t[at:start] + f"[{kind.upper()}]"
            at = max(at, -end)
        assert r.text == out + t[at:]


def test_query_columns_equal_plain_spans(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries()["op5_pii"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        plain = plain_base(docs[r.doc_id])
        listed = [x for k in plain.values() for x in k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in plain.values()]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert spans[: len(listed)] == listed and all(x.split(":")[0] in ("iban", "ssn") for x in spans[len(listed) :])


def duck(sql, sf):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return sorted(str(sorted(zip(names, row))) for row in r.fetchall())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracles(spark, name):
    df = queries()[name](spark, SMALL)
    assert sorted(str(sorted(r.asDict().items())) for r in df.collect()) == duck(oracle_sql()[name], SMALL)


ODD = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "x" * 90_000), (6, "x" * 90_000), (6, "x" * 90_000), (None, "a"), (None, "n"), (None, "n"), (9, "A"), (7, "a"), (7, "b")]


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            kept = i == keep and first
            first &= not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(str, out))


def test_dedup_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1, b"d") for r in ODD], "doc_id long, text string, locator int, digest binary")
    assert sorted(str(tuple(r)) for r in exact_dedup.deduplicate(df).collect()) == plain_dedup(ODD)
    left = exact_dedup.drop_duplicates(df)
    assert left.columns == df.columns
    assert sorted(map(str, {(r.doc_id, r.text or "") for r in left.collect()})) == sorted(map(str, {(7, "a"), (4, ""), (6, "x" * 90_000), (None, "n"), (9, "A"), (7, "b")})) and left.count() == 6
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0


def test_state_goes_on_over_batches(spark, tmp_path):
    place = str(tmp_path)
    one = spark.createDataFrame([(i, bytes([i % 7]), 1, i) for i in range(50)], exact_dedup.ARRIVAL)
    one.repartition(5).write.parquet(f"{place}/in")
    exact_dedup.run_stream(spark, f"{place}/in", f"{place}/state", f"{place}/out", files_per_batch=2)
    spark.createDataFrame([(100, bytes([3]), 1, 100), (101, bytes([9]), 1, 101)], exact_dedup.ARRIVAL).write.mode("append").parquet(f"{place}/in")
    exact_dedup.run_stream(spark, f"{place}/in", f"{place}/state", f"{place}/out")
    got = {r.digest[0]: (r.keep_id, r.keep_row, r.group_size) for r in exact_dedup.entries(spark, f"{place}/out").collect()}
    want = {k: (max(range(k, 50, 7)), max(range(k, 50, 7)), len(range(k, 50, 7))) for k in range(7)} | {9: (101, 101, 1)}
    want[3] = (100, 100, want[3][2] + 1)
    assert got == want


weak = lambda t: F.substring(t, 1, 1).cast("binary")


def test_later_runs_go_on_with_a_named_state(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda rows, **k: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(make(rows), **k).collect())
    state = str(tmp_path / "state")
    assert kept([(1, "aa"), (5, "aa"), (2, "b")], state=state) == [(1, 5, 2, False), (2, 2, 1, True), (5, 5, 2, True)]
    assert kept([(3, "aa"), (9, "b"), (4, "c")], state=state) == [(3, 5, 3, False), (4, 4, 1, True), (9, 9, 2, True)]
    # A later text that collides with an earlier one is found by the earlier one's content.
    state = str(tmp_path / "weak")
    kept([(1, "aa"), (2, "b")], state=state, digests=(weak, *exact_dedup.DIGESTS))
    assert kept([(3, "ab")], state=state, digests=(weak, *exact_dedup.DIGESTS)) == [(3, 3, 1, True)]


def test_colliding_digests_are_found_by_their_bytes(spark):
    rows = [(1, "aa"), (2, "ab"), (3, "aa"), (4, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_dedup.deduplicate(df, digests=(weak, *exact_dedup.DIGESTS))
    want = [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True)]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()) == want
    assert {r.doc_id: r.text_sha256 for r in out.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}
    assert sorted(r.doc_id for r in exact_dedup.drop_duplicates(df, digests=(weak, *exact_dedup.DIGESTS)).collect()) == [2, 3, 4]
    with pytest.raises(RuntimeError):
        exact_dedup.deduplicate(df, digests=(weak,))


def test_locators_find_the_content(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = exact_dedup.located(docs)
    wanted = rows.where("doc_id % 7 = 0").select(F.col("dedup_file").alias("file"), F.col("dedup_row").alias("row"), "doc_id")
    paths = rows.select(F.col("dedup_path").alias("path"), F.col("dedup_file").alias("file")).distinct()
    got = exact_dedup.contents(spark, paths, wanted, "text").join(wanted, ["file", "row"]).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.text) for r in docs.where("doc_id % 7 = 0").collect())


TEXTS = ["", None, "plain", "\\", "\\\\", "###", "####", "\\###", "</turn>", "\\</turn>\n</turn>\n", "### user:\n\n</turn>\n", "a:\nb", "\\n", "é😀\n", r"\### Assistant: </turn> ok", "x" * 70_000]


def test_format_round_trip(spark):
    rng = random.Random(9)
    pool = ["\\", "###", "#", "</turn>", "\n", ":", "n", "a", "### ", "</", "turn>"]
    texts = TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    rows = [(i, 0, r, t, 5) for i, t in enumerate(texts) for r in ("assistant", rng.choice(texts), None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, piece int")
    out = chat.format_turns(df)
    got = out.select("conv_id", chat.read_role(out.piece), chat.read_text(out.piece), chat.read_loss(out.piece, out.loss_start, out.loss_length)).collect()
    want = [(i, r or "", t or "", (t or "") if r == "assistant" else None) for i, _, r, t, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    for r in out.collect():
        assert len(re.findall(r"(?<!\\)(?:\\\\)*</turn>", r.piece)) == 1 and r.piece.endswith(chat.END)
    assert chat.format_turns(df.limit(0)).count() == 0


def test_layouts(spark):
    want = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    tables = [
        spark.sql("select 1L conv_id, array(named_struct('role','user','content','q'), named_struct('role','assistant','content','a')) messages, 'x' source"),
        spark.sql("select 1L conv_id, array(named_struct('from','human','value','q'), named_struct('from','gpt','value','a')) conversations"),
        spark.sql("select 1L conv_id, 'q' prompt, 'a' response"),
        spark.sql("select 1L conv_id, 'q' instruction, '' input, 'a' output"),
        spark.sql("select 1L conv_id, 'q' instruction, 'a' output, 3 score"),
        spark.sql("select 1L conv_id, cast(x.t as int) turn, x.r role, x.v text from (select explode(array(named_struct('t',0,'r','user','v','q'), named_struct('t',1,'r','assistant','v','a'))) x)"),
    ]
    for t in tables:
        assert sorted(map(tuple, chat.canonical(t).collect())) == want
    with pytest.raises(ValueError):
        chat.canonical(spark.range(1))


def test_mixed_layouts_lose_no_conversation(spark):
    one = "array<struct<role:string,content:string>>"
    rows = [(1, [("user", "q"), ("assistant", "a")], None, None, 1), (2, None, "q", "a", 1), (3, None, None, None, 1), (4, [], None, None, 1), (5, None, "q", None, 1), (6, [("user", "q")], "p", "r", None), (None, None, "n", "a", 1)]
    df = spark.createDataFrame(rows, f"conv_id long, messages {one}, prompt string, response string, score int")
    got = {}
    for r in chat.canonical(df).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    pair = [(0, "user", "q"), (1, "assistant", "a")]
    assert got == {1: pair, 2: pair, 3: [(None, "", "")], 4: [(None, "", "")], 5: [(0, "user", "q"), (1, "assistant", "")], 6: [(0, "user", "q")], None: [(0, "user", "n"), (1, "assistant", "a")]}
    rng = random.Random(3)
    rows = [(i, *[rng.choice([None, "", "x"]) for _ in range(5)]) for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, instruction string, input string, output string, prompt string, response string")
    assert chat.format_turns(df).select("conv_id").distinct().count() == 200


def test_turns_with_equal_numbers_are_ordered_by_text(spark, tmp_path):
    texts = ["###", "A", "\\", "a", "", "</turn>", "Z", "\\###", None, "[", "^"]
    rows = [(1, 0, r, t) for t in texts for r in ("user", "assistant")] + [(2, i % 3, "assistant", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op8_chat"](spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    r = c.execute(oracle_sql()["op8_chat"])
    names = [d[0] for d in r.description]
    assert sorted(str(sorted(x.asDict().items())) for x in got) == sorted(str(sorted(zip(names, row))) for row in r.fetchall())


def test_dedup_of_derived_tables(spark, tmp_path):
    """Each row is one row, also where a file's row comes several times."""
    spark.createDataFrame([(1, ["x y z", "q"]), (2, ["x y z", "q"]), (3, ["other", "x y z"])], "n long, texts array<string>").write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    exploded = read.select("n", F.posexplode("texts").alias("i", "text")).select((10 * F.col("n") + F.col("i")).alias("doc_id"), "text")
    joined = read.select("n").join(spark.createDataFrame([("x y z",), ("q",), ("q",)], "text string").repartition(1)).select((F.col("n")).alias("doc_id"), "text")
    sampled = read.select(F.col("n").alias("doc_id"), F.col("texts")[0].alias("text")).sample(True, 5.0, 3)
    for df in (exploded, joined, sampled, exploded.union(exploded), exploded.union(sampled)):
        rows = df.cache().collect()
        best = {}
        for r in rows:
            best[r.text] = max(r.doc_id, best.get(r.text, r.doc_id))
        out = exact_dedup.deduplicate(df).collect()
        assert len(out) == len(rows) and sum(r.kept for r in out) == len(best)
        assert all(r.keep_id in best.values() for r in out)
        assert sorted((r.text, r.doc_id) for r in exact_dedup.drop_duplicates(df).collect()) == sorted(best.items())
    assert exact_dedup.bare_scan(read.where("n > 1").select("n")) and not exact_dedup.bare_scan(exploded)
