"""The thin queries over the operators: production parameters, whole tables, and the digests that the contracts ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bktree, bpe_trie, chat, debruijn, exact_dedup, langid, negatives, packing, pii, repair, simhash, toxicity, turns
from .common import scratch, shared_dir, table, tokenizer_path
from .votes import hex16

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))


def op1_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_trie.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(BYTE))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    out = toxicity.score(docs, net)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    out = simhash.fingerprint_edits(table(spark, sf_dir, "documents")).checkpoint()  # some 150 bytes a document
    found = simhash.count_near(out)
    out = out.join(found, (out.fp == found.query_fp) & (out.doc_id % 100 == 0), "left")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex16(F.col("fp")).alias("fingerprint"),
        hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        simhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        simhash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.col("n_near"),
    )


def op4_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scratch(spark, "repair")
    repair.write_shards(table(spark, sf_dir, "documents"), files, tokenizer_path(WORD))
    out = repair.read_shards(spark, files)
    return out.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in pii.BASE]
    return out.select("doc_id", *counts, F.sha2(pii.listed(pii.BASE), 256).alias("base_sha256"), pii.listed(pii.KINDS).alias("spans"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


#: The added conversation: control strings and a backslash inside the texts.
ADDED = r"\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED).alias("text"))
    pieces = chat.format_turns(rows.unionByName(added))
    back = F.struct("turn", chat.read_role(F.col("piece")).alias("role"), chat.read_text(F.col("piece")).alias("text"), F.when(F.col("loss_start").isNotNull(), chat.read_loss(F.col("piece"), F.col("loss_start"), F.col("loss_length"))).alias("loss"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(back)).alias("p"), F.sum(F.length("piece")).alias("formatted_chars"))
    turns = F.array_join(F.transform("p", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("p", lambda t: t["loss"].isNotNull()), lambda t: t["loss"]), "")
    read = whole.select("conv_id", F.size("p").cast("long").alias("n_turns"), turns.alias("turns"), loss.alias("loss"), "formatted_chars")
    return read.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op9_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bktree.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op10_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold(4) != 2)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "mixture")


def op11_annulus_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_debruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, _ = debruijn.remove_repeats(table(spark, sf_dir, "documents"), 35, keep=False)
    return texts.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, repaired = turns.repair(turns.damage(rows))
    hashes = turns.digests(repaired)
    found = report.join(hashes, report.conv_id.eqNullSafe(hashes.conv_id)).drop(hashes.conv_id)
    every = rows.select(F.col("conv_id").alias("original")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = every.join(found, every.original.eqNullSafe(found.conv_id), "left")
    return out.select(F.col("original").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_bpe_trie, op2_toxicity, op3_simhash, op4_repair_shards, op5_pii, op6_harmonic_packing, op7_stream_dedup, op8_chat, op9_bktree, op10_mixture_langid, op11_annulus_negatives, op12_debruijn_repeats, op13_turn_repair)
}

#: SQL for what SQL can express. The others (BPE, trained models, hash votes, grammars, span places) are held against brute
#: force, exact round trips and held-out rows in tests/llm.
ORACLES: dict[str, str] = {
    "op7_stream_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), e AS (
            SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
                replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:'), chr(10), '\n') AS head
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(6 + length(head) + length(body) + 9)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
}


def _op13() -> str:
    """The cheapest edits as a recursive walk over the rows: for each state the least (cost, audit), written as one text."""
    step = lambda v, cost, letter: f"(lpad((substr({v}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({v}, 10) || '{letter}')"
    insert = lambda v: step(v, 3, "I")
    return f"""
        WITH RECURSIVE named AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
        ), hashed AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(name) + 1), lambda i: list_transform(range(0, 8), lambda b: (ascii(name[i]) >> b::INT)::BIGINT & 1)))),
                lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 AS kind
            FROM named
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM hashed, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
        ), judged AS (
            SELECT *, role[1:1] AS x, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
            FROM placed
        ), walk AS (
            SELECT conv_id, 0::BIGINT AS i, '000000000' AS v0, NULL::VARCHAR AS v1, '000000003I' AS v2, '000000006II' AS v3 FROM (SELECT DISTINCT conv_id FROM judged)
            UNION ALL
            SELECT conv_id, i, t0, t1, least(t2, {insert('t0')}, {insert('t1')}, {insert('t3')}), least(t3, {insert('t2')}, {insert(insert('t0'))}, {insert(insert('t1'))})
            FROM (
                SELECT w.conv_id, j.i, {step('v0', 4, 'D')} AS t0,
                    least({step('v1', 4, 'D')}, CASE WHEN free AND x = 's' THEN {step('v0', 'e', 'K')} END) AS t1,
                    least({step('v2', 4, 'D')}, CASE WHEN free AND x = 'u' THEN least({step('v0', 'e', 'K')}, {step('v1', 'e', 'K')}, {step('v3', 'e', 'K')}) END,
                        CASE WHEN free THEN least({step('v0', 'e + 3', 'R')}, {step('v1', 'e + 3', 'R')}, {step('v3', 'e + 3', 'R')}) END) AS t2,
                    least({step('v3', 4, 'D')}, CASE WHEN free AND x = 'a' THEN {step('v2', 'e', 'K')} END, CASE WHEN free THEN {step('v2', 'e + 3', 'R')} END) AS t3
                FROM walk w JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS e FROM judged) j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
            )
        ), ends AS (
            SELECT conv_id, substr(least(v0, v3), 1, 9)::BIGINT AS cost, substr(least(v0, v3), 10) AS audit FROM walk QUALIFY i = max(i) OVER (PARTITION BY conv_id)
        ), letters AS (
            SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, audit[p] AS letter FROM ends
        ), taken AS (
            SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS place FROM letters
        ), written AS (
            SELECT t.conv_id, p, place, letter, CASE WHEN letter <> 'I' THEN j.text ELSE '' END AS text, j.role, max(CASE WHEN letter = 'K' AND place = 1 AND x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY t.conv_id) AS led
            FROM taken t LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM t.conv_id AND j.i = t.i WHERE letter <> 'D'
        ), hashes AS (
            SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS repaired_sha256 FROM written GROUP BY conv_id
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY conv_id
        )
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
            coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
            LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    """


ORACLES["op11_annulus_negatives"] = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
    ), p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    ), n AS (
        SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
ORACLES["op12_debruijn_repeats"] = r"""
    WITH d AS (
        SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), w AS (
        SELECT row, unnest(range(1, len(words) - 33)) AS i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM d
    ), r AS (
        SELECT row, i FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1
    ), g AS (
        SELECT DISTINCT row, unnest(range(i, i + 35)) AS i FROM r
    ), k AS (
        SELECT row, list(i) AS gone FROM g GROUP BY row
    ), o AS (
        SELECT d.row, doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed, words, gone FROM d LEFT JOIN k USING (row)
    ), p AS (
        SELECT row, string_agg(word, ' ' ORDER BY i) AS kept
        FROM (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM o) x LEFT JOIN g USING (row, i) WHERE g.i IS NULL GROUP BY row
    )
    SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM o LEFT JOIN p USING (row)
"""
ORACLES["op13_turn_repair"] = _op13()


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
