"""Reading a tokenizer's JSON, and fast encoders that give what the tokenizers library gives.

Two kinds of file are read: byte-level BPE, and byte-level BPE with a word-end suffix. Both go through tiktoken's
merge loop, with a vocabulary made from the file's merges.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

# The split patterns of the two public vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out.values()):
        out[chr(256 + i)] = b
    return out


class Vocabulary:
    """tokens: bytes by id; pairs: (left id, right id) -> (rank, merged id); added: content -> id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        model, alphabet = raw["model"], byte_alphabet()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in raw["added_tokens"]}
        self.ids = model["vocab"]
        self.tokens: list[bytes] = [b""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for token, i in self.ids.items():
            body = token.removesuffix(self.suffix) if self.suffix else token
            self.tokens[i] = bytes(alphabet[c] for c in body)
        for content, i in self.added.items():
            self.tokens[i] = content.encode()
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[self.ids[a], self.ids[b]] = rank, self.ids[a + b]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def library(path: str):
    """The tokenizers library's own tokenizer."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class ByteEncoder:
    """Byte-level BPE: ids of a text as the tokenizers library gives them without added special tokens."""

    def __init__(self, path: str):
        v = vocabulary(path)
        ranks = {v.tokens[i]: i for i in v.ids.values()}
        self.encoding = tiktoken.Encoding("byte", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=v.added)
        self.added = list(v.added)
        self.path = path

    def encode(self, text: str) -> np.ndarray:
        try:
            if any(a in text for a in self.added):
                return np.array(self.encoding.encode(text, allowed_special="all"), np.uint32)
            return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        except ValueError:  # its splitter gives up on white space of about a million characters
            return np.array(library(self.path).encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_batch(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        return [self.encode(t) for t in (texts if isinstance(texts, list) else texts.to_pylist())]


#: Chunks between white space that a worker remembers.
CHUNKS = 500_000

#: Ends a word on its way to tiktoken; a text that holds it goes through the tokenizers library.
END = "\x01"


class WordEncoder:
    """BPE with a word-end suffix. A word's last symbol carries the suffix; here an end byte follows the word, and the
    merges of a byte with the end byte come before all others, which gives the same symbols to start from."""

    def __init__(self, path: str):
        v = vocabulary(path)
        end = END.encode()
        ordered: list[tuple[bytes, int]] = []
        singles = {t: i for t, i in v.ids.items() if len(t.removesuffix(v.suffix)) == 1}
        for t, i in singles.items():
            if t.endswith(v.suffix):
                ordered.append((v.tokens[i] + end, i))
        for _, i in sorted(v.pairs.values()):
            name = v.tokens[i]
            ordered.append((name, i))
        marked = {i for t, i in v.ids.items() if t.endswith(v.suffix)}
        ranks, self.id_of = {}, []
        for name, i in ordered:
            key = name if name.endswith(end) else name + end if i in marked else name
            ranks[key] = len(self.id_of)
            self.id_of.append(i)
        plain = {v.tokens[i]: i for t, i in singles.items() if not t.endswith(v.suffix)}
        for b in range(256):
            ranks[bytes([b])] = len(self.id_of)
            self.id_of.append(plain.get(bytes([b]), 0))
        self.id_of = np.array(self.id_of, np.uint32)
        self.ends = np.zeros(len(v.tokens), bool)
        self.ends[list(marked)] = True
        self.chunks, self.coded = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.encoding = tiktoken.Encoding("word", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(WORD_PATTERN)
        self.added = list(v.added)
        self.exact = library(path)

    def encode(self, text: str) -> np.ndarray:
        if END in text or any(a in text for a in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        # Letter by letter, as the library does: without the Greek rule for a word's last sigma.
        words = self.words.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())
        if not words:
            return np.zeros(0, np.uint32)
        return self._ids(words)

    def _ids(self, words: list[str]) -> np.ndarray:
        words.append("")
        return self.id_of[self.encoding.encode_to_numpy(END.join(words), allowed_special=set(), disallowed_special=())]


    def learn(self, new: list[str]) -> list[bytes]:
        """The ids of distinct chunks that hold no ASCII white space, as little-endian bytes."""
        whole = "\n".join(new)
        marks = [a for a in (END, *self.added) if a in whole]
        odd = {i for i, c in enumerate(new) if any(a in c for a in marks)} if marks else set()
        folded = unicodedata.normalize("NFC", whole).replace("\u03a3", "\u03c3").lower().split("\n")
        find = self.words.findall
        # Plain words, with one mark behind them at most, need no pattern.
        words = [[c] if c.isascii() and c.isalpha() else [c[:-1], c[-1]] if c.isascii() and c[:-1].isalpha() and c[-1] in ".,;:!?" else find(c) for c in folded]
        for i in odd:
            words[i] = []
        ids = self._ids([w for ws in words for w in ws])
        # A word has one token with the suffix, its last, which tells where each chunk's ids end.
        last = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        at = (4 * last[np.cumsum([0] + [len(ws) for ws in words])]).tolist()
        data = ids.astype("<u4").tobytes()
        out = [data[a:b] for a, b in zip(at, at[1:])]
        for i in odd:
            out[i] = np.array(self.exact.encode(new[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def encode_batch(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text. No word spans white space, so each distinct chunk between ASCII white space is encoded
        once, and a worker remembers a bounded number of them."""
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        coded = parts.values.dictionary_encode()
        chunks = coded.dictionary
        at = pc.index_in(chunks, value_set=self.chunks)
        new = chunks.filter(at.is_null())
        known, found = self.chunks, self.coded
        if len(new):
            # As one string, since no chunk holds a line feed: faster than one by one.
            listed = pc.binary_join(pa.ListArray.from_arrays([0, len(new)], new), "\n")[0].as_py().split("\n")
            known, found = pa.concat_arrays([known, new]), pa.concat_arrays([found, pa.array(self.learn(listed), pa.large_binary())])
            at = pc.coalesce(at, pa.array(len(self.chunks) + np.cumsum(at.is_null().to_numpy(zero_copy_only=False)) - 1, pa.int32()))
        own = found.take(at)
        self.chunks, self.coded = (chunks, own) if len(known) > CHUNKS else (known, found)
        placed = own.take(coded.indices)
        ends = np.frombuffer(placed.buffers()[1], np.int64, len(placed) + 1) // 4
        ids = np.frombuffer(placed.buffers()[2] or b"", "<u4")
        cuts = ends[parts.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


@cache
def encoder(path: str) -> ByteEncoder | WordEncoder:
    """The encoder for a file, once per worker."""
    return (WordEncoder if vocabulary(path).suffix else ByteEncoder)(path)
