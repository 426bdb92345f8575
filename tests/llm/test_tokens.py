"""BPE, packing and shard files against the tokenizers library and brute force."""

import hashlib
import random
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from docketspark.llm import bpe_trie, packing, repair
from docketspark.llm.vocab import encoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "aaaa" * 50, "x" * 30_000, "<|endoftext|>a <|endoftext|>", "  two  spaces \n\n \t", "É ΣΑΣ ß 中文 😀 'll 12 345", "\x01\x1c\x85　", "the the the"]


def docs(spark):
    rng = random.Random(5)
    pool = [chr(c) for c in range(1, 0x250)] + list(" \n't") * 40
    rows = [(i, t) for i, t in enumerate(ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 3000))) for _ in range(60)])]
    rows += [(3, "repeated id"), (5, "x" * 30_000), (None, "no id")]
    return rows, spark.createDataFrame([(*r, 1, b"q") for r in rows], "doc_id long, text string, ids int, offset binary")


tokenizer = cache(Tokenizer.from_file)


def reference(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def test_trie_equals_the_library(spark):
    rows, df = docs(spark)
    tk = Tokenizer.from_file(BYTE)
    got = sorted(((r.doc_id is None, r.doc_id or 0), list(r.ids), r.decoded) for r in bpe_trie.encode_decode(df, BYTE).collect())
    want = sorted(((i is None, i or 0), tk.encode(t or "", add_special_tokens=False).ids, tk.decode(tk.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows)
    assert got == want


def test_every_token_is_its_own_encoding():
    trie = bpe_trie.TrieEncoder(BYTE)
    words = sorted(trie.id_of)
    assert list(trie.walk(words)) == [(trie.id_of[w],) for w in words]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_fast_encoders_equal_the_library(spark, path):
    texts = [t or "" for _, t in docs(spark)[0]] + ["a  b", " \na", "a\n \nb", "a \x1c b", "\xa0 a \xa0b", "ΣΑΣ <|startoftext|>x"]
    want = [reference(path, t) for t in texts]
    assert [encoder(path).encode(t).tolist() for t in texts] == want
    assert [x.tolist() for x in encoder(path).encode_batch(texts)] == want
    if path == BYTE:
        assert [x.tolist() for x in bpe_trie.TrieEncoder(path).encode_batch(texts)] == want
    assert encoder(path).encode_batch([]) == []


@pytest.mark.parametrize("c", [" ", "\n", "\t", "\u00a0", "a", "1", ".", "é", "中", "<|endoftext|> "])
def test_very_long_runs(c):
    text = "begin" + c * (1_200_000 // len(c)) + "end"
    assert encoder(BYTE).encode(text).tolist() == reference(BYTE, text)
    assert encoder(WORD).encode_batch([text])[0].tolist() == reference(WORD, text)
    text = text[-100_000:]
    assert bpe_trie.trie_encoder(BYTE).encode_batch([text])[0].tolist() == reference(BYTE, text)


def test_query_columns_of_shards_and_sequences(spark):
    from docketspark.llm.registry import op4_repair_shards, op6_harmonic_packing

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    at, got = 0, {r.doc_id: r for r in op4_repair_shards(spark, "/root/testdata/sf0.001").collect()}
    for i in sorted(texts):
        ids = np.array([*reference(WORD, texts[i]), 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    pieces, sequences = {}, {}
    for r in op6_harmonic_packing(spark, "/root/testdata/sf0.001").collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for i, text in texts.items():
        ids, at = np.array([*reference(BYTE, text), 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    filled = {s: sum(n for _, n in p) for s, p in sequences.items()}
    assert all(sorted(p)[0][0] == 0 and sum(n for _, n in p) <= 2048 for p in sequences.values())
    assert sum(n for n in filled.values()) > 0.98 * sum(n if n & (n - 1) == 0 else 2048 for n in filled.values())


def test_packing_keeps_every_id_once(spark):
    rows, df = docs(spark)
    out = packing.pack(df, BYTE).collect()
    sequences, pieces = {}, {}
    for r in out:
        assert len(r.ids) == 4 * r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    want = {}
    for i, t in rows:
        ids = np.array([*reference(BYTE, t), 1], "<u4").tobytes()
        want.setdefault((i, len(ids) // 4), []).append(ids)
    for key, texts in want.items():
        got = sorted(pieces[key], key=lambda p: p[0])
        assert sum(len(p) for _, p in got) == sum(map(len, texts))
        if len(texts) == 1:
            assert b"".join(p for _, p in got) == texts[0]
    assert packing.pack(df.limit(0), BYTE).count() == 0


def test_cut_wastes_little():
    for n in range(1, 6000):
        parts = packing.cut(n, 2048)
        assert sum(p for _, p in parts) == n
        assert all(k * p <= 2048 and 2048 // k - p <= packing.WASTE * (2048 // k) for k, p in parts)


def test_later_rounds_of_repair_count_only_what_can_be_frequent(monkeypatch):
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 60, n).astype(np.uint32) for n in rng.integers(2, 40, 300)]
    ids = np.concatenate([words[i] for i in rng.integers(0, 300, 6000)])
    sizes, count = [], np.bincount

    def counted(x, *a, **b):
        sizes.append(len(x))
        return count(x, *a, **b)

    monkeypatch.setattr(np, "bincount", counted)
    g = repair.compress(ids, 60)
    monkeypatch.undo()
    assert np.array_equal(g.expand(g.symbols), ids) and np.array_equal(g.lengths, [len(g.expand(np.array([60 + i]))) for i in range(len(g.rules))])
    left = g.symbols.astype(np.int64)
    found, n = np.unique((left[:-1] << 32 | left[1:])[left[:-1] != left[1:]], return_counts=True)
    assert n.max() < repair.LEAST and sum(sizes) < 4.2 * len(ids)


def test_chunks_are_remembered_across_batches_and_when_there_are_many(monkeypatch):
    from docketspark.llm import vocab

    monkeypatch.setattr(vocab, "CHUNKS", 20)
    own = vocab.WordEncoder(WORD)
    for texts in (["one two, three.", "", "Zo\u00eb's two,"], [" ".join(f"w{i}x." for i in range(15)), "one"], ["\u03a3\u03a3, two, a\x01b", "w3x. *"], [f"new{i}!" for i in range(30)]):
        assert [x.tolist() for x in own.encode_batch(texts)] == [reference(WORD, t) for t in texts]
        assert isinstance(own.chunks, pa.Array) and len(own.chunks) == len(own.coded) <= 30


def test_a_shard_is_read_at_once_as_by_documents(monkeypatch):
    rng = np.random.default_rng(5)
    docs = [(i, np.tile(rng.integers(0, 50, 40), 30).astype(np.uint32)) for i in range(20)]
    s = repair.Shard(repair.to_row(0, 0, 0, docs, 50))
    want = np.concatenate([x for _, x in docs])
    for many in (1, 10**6):  # by a table of symbols, or level by level
        s.symbol_ends = s.symbol_ends * many
        assert np.array_equal(s.all_ids(), want)


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for ids in [np.zeros(0, np.uint32), np.array([1], np.uint32), np.zeros(5000, np.uint32), rng.integers(0, 30, 20_000).astype(np.uint32), rng.integers(0, 70_000, 5000).astype(np.uint32)]:
        g = repair.compress(ids, int(ids.max(initial=0)) + 1)
        assert (g.expand(g.symbols) == ids).all()
        for a, b in [(0, 0), (0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, len(ids))]:
            if 0 <= a <= b:
                assert (g.slice(a, b) == ids[a:b]).all()
    assert len(repair.compress(np.zeros(5000, np.uint32), 1).symbols) < 1000


def test_shard_files(spark, tmp_path):
    rows, df = docs(spark)
    repair.write_shards(df, str(tmp_path / "s"), WORD, shard_tokens=500)
    got = sorted(((r.start, r.doc_id, len(r.ids) // 4, zlib.crc32(r.ids)) for r in repair.read_shards(spark, str(tmp_path / "s")).collect()), key=lambda x: x[0])
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*reference(WORD, t), 1], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    shards = [repair.Shard(r.asDict()) for r in spark.read.parquet(str(tmp_path / "s")).collect()]
    for s in shards:
        whole = s.all_ids()
        for i in range(len(s.ends)):
            assert (s.document(i) == whole[(s.ends[i - 1] if i else 0) : s.ends[i]]).all()
    repair.write_shards(df.limit(0), str(tmp_path / "e"), WORD)
    assert repair.read_shards(spark, str(tmp_path / "e")).count() == 0


def test_query_digests(spark):
    from docketspark.llm.registry import op1_bpe_trie

    docs_ = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op1_bpe_trie(spark, "/root/testdata/sf0.001").collect():
        ids = reference(BYTE, docs_[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs_[r.doc_id].encode()).hexdigest()
