"""Fingerprints, edits, near search, BK-trees and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from docketspark.llm import bktree, simhash
from docketspark.llm.registry import op3_simhash, op9_bktree

SMALL = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, k=4):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f, least.get(find(f))) for i, f in rows]


def sort_key(r):
    return (r[0] is None, r[0] or 0, str(r[1:]))


def test_components_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op9_bktree(spark, SMALL).collect()]
    assert sorted(got) == sorted(want)


def test_components_of_odd_rows(spark):
    base = "one two three four five six seven eight nine ten É Ä a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    rows = [(7, None), (5, ""), (9, " \t\n"), (3, "A b"), (4, "a B"), (3, "A b"), (None, "a b"), (None, "only here alone"), (11, "x" * 50_000 + " y"), (12, "É É É É É"), (13, "é é é é é")]
    rng = random.Random(2)
    for i in range(40):
        w = base * 6
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    got = [(r.doc_id, r.fp & ((1 << 64) - 1), r.component_id) for r in bktree.near_duplicates(df).collect()]
    assert sorted(got, key=sort_key) == sorted(want, key=sort_key)
    assert bktree.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(min(a, b), max(a, b)) for a, b in zip(order, order[1:])] + [(1000, 1001), (1001, 1002)]
    got = {r.node: r.root for r in bktree.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000, 1002: 1000}


def test_forest_finds_every_link():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    for _ in range(3):
        fp = np.unique(np.concatenate([fp, fp ^ (np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64))]))
    key = np.sort(rng.integers(0, 4, len(fp)))
    forest = bktree.Forest(key, fp)
    got = {(int(a), int(b)) for x, y in forest.links(key, fp, 4) for a, b in zip(x, y) if a != b}
    assert got == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if i != j and key[i] == key[j] and int(fp[i] ^ fp[j]).bit_count() <= 4}


def plain_weighted(text):
    words = SPACE.findall(text.lower())
    terms = [" ".join(words[i : i + 2]) for i in range(len(words))]
    votes = [(xxhash.xxh64_intdigest(t.encode(), seed=42), min(4, 1 + len(t) // 6)) for t in terms]
    total = sum(w for _, w in votes)
    return sum(1 << b for b in range(64) if 2 * sum(w for h, w in votes if h >> b & 1) > total)


def check_edits(rows, got):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 4
        e = t[: len(t) - n] + following[:n]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_weighted(t), plain_weighted(e), plain_weighted(following)))
    assert sorted(got, key=sort_key) == sorted(want, key=sort_key)


def fields(r):
    u = (1 << 64) - 1
    return (r.doc_id, r.n_chars, r.edited_sha256, r.fp & u, r.edited_fp & u, r.next_fp & u)


def test_edits(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_edits(rows, [fields(r) for r in simhash.fingerprint_edits(df).collect()])
    odd = [(4, None), (9, ""), (2, "abc"), (None, "no id at all here"), (7, "😀" * 9), (7, "a tie of ids"), (7, "a tie of ids"), (1, "x y " * 20_000), (30, " ")]
    df = spark.createDataFrame([(*r, 1, "q") for r in odd], "doc_id long, text string, bucket int, next_text string")
    check_edits(odd, [fields(r) for r in simhash.fingerprint_edits(df).collect()])
    check_edits(odd[2:3], [fields(r) for r in simhash.fingerprint_edits(df.where("doc_id = 2")).collect()])
    assert simhash.fingerprint_edits(df.limit(0)).count() == 0


def test_edits_query(spark):
    got = op3_simhash(spark, SMALL).collect()
    assert len(got) == 200 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    for r in got:
        assert r.n_near == (sum((prints[r.doc_id] ^ f).bit_count() <= 3 for f in prints.values()) if r.doc_id % 100 == 0 else None)
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.15


def test_near_equals_brute_force(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in prints] + [0, 0, 1]
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {(r.query_fp, r.fp, r.distance) for r in simhash.near(df, df).collect()}
    u = (1 << 64) - 1
    assert got == {(a, b, ((a ^ b) & u).bit_count()) for a in signed for b in signed if ((a ^ b) & u).bit_count() <= 3}


def plain_similar(rows, k=5, least=0.8):
    """The rows that stay when all pairs are compared."""
    sets = [bktree.shingle_set(t or "", k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bktree.alike(sets[i], sets[j], least):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(d, first.get(find(i), d))
    return {d for i, (d, _) in enumerate(rows) if d is None or d == first[find(i)]}


def test_similar_texts_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_similar(rows)
    got = {r.doc_id for r in bktree.drop_near_duplicates(docs).collect()}
    assert got == want


def test_similar_odd_rows(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A B"), (5, "a c"), (None, "a b"), (None, "z"), (6, "x " * 30_000), (7, "x " * 29_000)]
    for i in range(30):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(300)] = f"new{rng.random()}"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, body int, shards int")
    out = bktree.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == plain_similar(rows)
    assert bktree.drop_near_duplicates(df.limit(0)).count() == 0


def test_every_similar_group_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(300)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(8)
    for i in range(150):  # pairs just above the threshold: changed words apart, and one line again and again
        w = [f"v{i}.{j}" for j in range(40)]
        x = [*w[:36], *(f"x{i}.{j}" for j in range(rng.randint(2, 4)))]
        rows += [(10**6 + 4 * i, " ".join(w)), (10**6 + 4 * i + 1, " ".join(x))]
        line = w[:8] * 40
        rows += [(10**6 + 4 * i + 2, " ".join([*w, *w[:8]])), (10**6 + 4 * i + 3, " ".join([*w, *line]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in bktree.drop_near_duplicates(df).collect()} == plain_similar(rows)


def test_trees_prune_by_the_radius():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    forest = bktree.Forest(np.zeros(3000, np.int64), fp)
    found = sum(len(a) for a, _ in forest.links(np.zeros(200, np.int64), fp[:200], 4))
    assert found == 200 and forest.visited < 0.75 * 200 * 3000


def test_fingerprints_of_sets():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in [0, 1, 5, 300_000, 0, 64, 7]]
    for hs, words in zip(sets, bktree.set_prints(sets)):
        bits = np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1).astype(int).sum(0) * 2 > len(hs)
        assert words[0] == (np.packbits(bits).view(np.uint64)[0] if len(hs) else 0)


def test_shingle_sets_equal_plain_ones():
    rng = random.Random(12)
    pool = ["a", "A", "b", "É", "é", " ", "  ", "\t", "\n", "\x0b\x0c\r", "\u00a0", "c d", "\x1c"]
    texts = ["", " ", "a", "a b c", " a b c d e f ", "x " * 20_000] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    got, seen = bktree.shingle_sets(pa.array(texts), 5), {}
    for t, hs in zip(texts, got):
        want = bktree.shingle_set(t, 5)
        assert len(want) == len(hs) and (np.diff(hs.astype(object)) > 0).all()
        for other, h in seen.items():
            assert len(want & other) == len(np.intersect1d(hs, h))
        if len(seen) < 60:
            seen[want] = hs


def test_clusters_are_dealt_by_finer_shards(spark, monkeypatch):
    monkeypatch.setattr(bktree, "MOST", 8)
    rng = random.Random(7)
    centre = rng.getrandbits(63)
    prints = {centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(80)} | {rng.getrandbits(63) for _ in range(200)}
    rows = list(enumerate(sorted(prints)))
    want = {i: c for i, _, c in plain_components(rows)}
    df = spark.createDataFrame([(f,) for _, f in rows], "fp long")
    roots = {r.node: r.root for r in bktree.components(bktree.links(df)).collect()}
    of = {f: i for i, f in rows}
    assert {i: of[roots.get(f, f)] for i, f in rows} == want


def test_large_groups_give_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(bktree, "NODES", 50)
    rng = random.Random(9)
    passage, base, rows = [f"p{i}" for i in range(100)], [f"b{i}" for i in range(300)], []
    for i in range(200):
        near = list(base)
        near[rng.randrange(300)] = f"new{i}"
        rows += [(2 * i, " ".join(near)), (2 * i + 1, " ".join([*passage, *(f"own{i}.{j}" for j in range(60))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = bktree.met_texts(bktree.named_texts(docs, "text"), 0.8, len(rows), 5)
    assert bktree.near_texts(texts).count() < 10 * len(rows)
    assert {r.doc_id for r in bktree.drop_near_duplicates(docs).collect()} == plain_similar(rows)


@pytest.mark.parametrize("changed", [16, 30])
def test_families_below_the_threshold_give_few_links(spark, monkeypatch, changed):
    """Many texts share a base and differ in scattered words: no pair is alike (a Jaccard of about 0.47, 0.25), and what the steps
    give stays in proportion to the texts, also where a family is compared in blocks."""
    monkeypatch.setattr(bktree, "NODES", 60)
    monkeypatch.setattr(bktree, "HASHES", 20_000)
    rng = random.Random(changed)
    base, rows = [f"b{i}" for i in range(400)], []
    for i in range(300):
        w = list(base)
        for j in rng.sample(range(400), changed):
            w[j] = f"new{i}.{j}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 300, 3)]  # pairs that are alike
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = bktree.met_texts(bktree.named_texts(docs, "text"), 0.8, len(rows), 5)
    assert bktree.near_texts(texts).count() < 10 * len(rows)
    links, _ = bktree.similar_links(docs)
    assert links.count() < 10 * len(rows)
    assert {r.doc_id for r in bktree.drop_near_duplicates(docs).collect()} == plain_similar(rows)


def test_radius_keeps_alike_sets_and_few_others():
    rng = np.random.default_rng(6)

    def share(n, similarity):
        inside = 0
        for _ in range(200):
            both = round(2 * n * similarity / (1 + similarity))
            words = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
            a, b = bktree.set_prints([words[:n], words[n - both :]])
            inside += int(bktree.distance(a[None], b[None])[0]) <= int(bktree.reach(np.array(n)))
        return inside / 200

    assert share(9, 0.8) == share(60, 0.8) == share(400, 0.8) == 1
    assert share(400, 0.45) < 0.03 and share(400, 0.3) == 0


def test_names_of_helpers_in_the_input(spark):
    names = ["gone_body", "gone_twin", "gone_above", "own_body", "own_twin", "own_id", "near_body", "near_twin", "body", "twin", "t", "root", "h", "stays", "least"]
    rows = [(1, "a b c d e f g h i j", *names), (2, "a b c d e f g h i j", *names), (3, "x y", *names)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = bktree.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def test_set_prints_are_the_majority_of_each_bit():
    def plain(words):
        out = []
        for _ in range(bktree.WIDTH):
            bits = [sum(int(w) >> i & 1 for w in words) * 2 > len(words) for i in range(64)]
            out.append(sum(b << i for i, b in enumerate(bits)))
            words = (words ^ (words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            words ^= words >> np.uint64(32)
        return out

    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**64, n, np.uint64) for n in (0, 1, 2, 254, 255, 256, 510, 0, 3)] + [np.full(600, 2**64 - 1, np.uint64)]
    assert bktree.set_prints(sets).tolist() == [plain(s) if len(s) else [0] * bktree.WIDTH for s in sets]


def test_shingle_sets_are_distinct_shingles_of_the_words():
    texts = ["", " \t", "a", "A b\tc", " a  b c d e f ", "a b c d e " * 50, "Ä ä x y z", None]
    sets = bktree.shingle_sets(pa.array([t or "" for t in texts], pa.string()), 5)
    assert [len(s) for s in sets] == [len(bktree.shingle_set(t or "", 5)) for t in texts]
    assert all((s[1:] > s[:-1]).all() for s in sets) and bktree.shingle_sets(pa.array([], pa.string()), 5) == []
    assert sets[3].tolist() == bktree.shingle_sets(pa.array(["a b c"]), 5)[0].tolist()
