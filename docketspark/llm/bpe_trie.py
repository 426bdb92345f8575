"""BPE encoding over a trie of distinct words, and decoding.

The encoding of a word's prefix is fixed by its last token: it is the last token's predecessor state plus that token, and of
all tokens that end the prefix exactly one fits behind the state before it. So one last token per prefix describes the
encodings of all prefixes, and words that share a prefix share its states. The distinct words of a batch are visited in
byte order, which is a depth-first walk of their trie: the states on the path from the root are kept on a stack, the walk
goes back to where the next word branches off, and only the nodes below are computed. A word's ids follow by stepping back
from its last token.

Texts are split as the vocabulary's byte-level splitter does; strings of added tokens become their ids, as the tokenizers
library has it. Decoding joins the tokens' bytes and reads them as UTF-8 (ids cut within a character give U+FFFD).

Null texts count as empty and give no ids and an empty decoded text. Repeated rows give repeated results. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .vocab import BYTE_PATTERN, vocabulary

#: Characters after which a batch is encoded; words that a worker remembers; pairs whose fit it remembers.
BATCH_CHARS, WORDS, PAIRS = 4_000_000, 300_000, 400_000
#: Pieces between spaces that a worker remembers.
PIECES = 300_000


class TrieEncoder:
    def __init__(self, path: str):
        v = vocabulary(path)
        if v.suffix:
            raise ValueError("a byte-level vocabulary without a word-end suffix is needed")
        self.tokens, self.pairs, self.added = v.tokens, v.pairs, v.added
        self.id_of = {v.tokens[i]: i for i in v.ids.values()}
        self.longest: dict[bytes, int] = {}  # last three bytes -> length of the longest token that ends so
        for token in self.id_of:
            if len(token) > 2:
                self.longest[token[-3:]] = max(len(token), self.longest.get(token[-3:], 0))
        self.made = {merged: (a, b, rank) for (a, b), (rank, merged) in v.pairs.items()}
        self.split = regex.compile(BYTE_PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(v.added, key=len, reverse=True))) + ")") if v.added else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.right, self.left = cache(lambda t: self._edge(t, 1)), cache(lambda t: self._edge(t, 0))
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols that stand at a token's edge while it is built, each with the rank of the merge that takes it away."""
        out, gone = [(token, float("inf"))], token
        while gone in self.made:
            a, b, rank = self.made[gone]
            gone = (a, b)[side]
            out.append((gone, rank))
        return out

    def fit(self, a: int, b: int) -> bool:
        """Whether b can follow a: no merge across the boundary comes before those that build the two.

        Of merges with equal rank the left one goes first, so one inside a does and one inside b doesn't prevent it."""
        known = self.fits.get((a, b))
        if known is None:
            known = True
            for x, taken_x in self.right(a):
                for y, taken_y in self.left(b):
                    merge = self.pairs.get((x, y))
                    if merge is not None and merge[0] < taken_x and merge[0] <= taken_y:
                        known = False
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            self.fits[a, b] = known
        return known

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[int, ...]]:
        """The ids of distinct words that come in byte order."""
        path: list[int] = []  # the last token of each prefix on the way from the root
        before = b""
        id_of, longest, tokens, fits, fit = self.id_of.get, self.longest.get, self.tokens, self.fits, self.fit
        for word in words:
            n, shared = len(word), 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del path[shared:]
            for end in range(shared + 1, n + 1):
                for start in range(max(0, end - longest(word[max(0, end - 3) : end], 2)), end):
                    token = id_of(word[start:end])
                    if token is not None:
                        if not start:
                            break
                        last = path[start - 1]
                        known = fits.get((last, token))
                        if known or known is None and fit(last, token):
                            break
                path.append(token)
            ids, end = [], n
            while end:
                ids.append(path[end - 1])
                end -= len(tokens[ids[-1]])
            yield tuple(reversed(ids))
            before = word

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of all words, as 32-bit integers; what the worker remembers is bounded."""
        known, new = {}, []
        for w in words:
            if (ids := self.words.get(w)) is None:
                new.append(w)
            else:
                known[w] = ids
        new.sort(key=str.encode)
        fresh = {w: array("i", ids).tobytes() for w, ids in zip(new, self.walk(map(str.encode, new)))}
        if len(self.words) + len(fresh) > WORDS:
            self.words = dict(known)
        if len(self.words) + len(fresh) <= 2 * WORDS:
            self.words.update(fresh)
        return known | fresh

    def pretokens(self, text: str) -> list[str]:
        """The words of a text in order; strings of added tokens are words of their own."""
        if self.cut is None or not any(a in text for a in self.added):
            return self.split.findall(text)
        return [w for piece in self.cut.split(text) for w in ([piece] if piece in self.added else self.split.findall(piece))]

    def encode_words(self, parts: list[list[str]]) -> list[bytes]:
        """The ids of lists of words, as 32-bit integers."""
        ids = self.learn(set(chain.from_iterable(parts)) - self.added.keys())
        ids |= {a: array("i", [i]).tobytes() for a, i in self.added.items()}
        get = ids.__getitem__
        return [b"".join(map(get, words)) for words in parts]

    def encode_batch(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text.

        A space before anything but white space always begins a word, so texts are cut there and each distinct piece is split
        into words once. Texts where a space is followed by white space, and those with added tokens, are split as a whole."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        parts = pc.split_pattern(texts, " ")
        coded = parts.values.dictionary_encode()
        codes, pieces, offsets = coded.indices.to_numpy(), coded.dictionary.to_pylist(), parts.offsets.to_numpy().astype(np.int64)
        firsts = np.zeros(len(codes), bool)
        firsts[offsets[:-1]] = True
        special = np.zeros(len(pieces), bool)
        if any(a in "\n".join(pieces) for a in self.added):
            special[:] = [any(a in p for a in self.added) for p in pieces]
        odd = special | np.fromiter((p[:1].isspace() or not p for p in pieces), bool, len(pieces))
        bad = special[codes] | odd[codes] & ~firsts
        slow = set((np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1).tolist())

        known = self.pieces
        found = list(map(known.get, pieces))
        new = [i for i, f in enumerate(found) if f is None and not odd[i]]
        find = self.split.findall
        whole = sorted(slow)
        heads = [i for i in range(len(texts)) if i not in slow]
        work = [find(" " + pieces[i]) for i in new] + [find(pieces[codes[offsets[i]]]) for i in heads] + [self.pretokens(texts[i].as_py()) for i in whole]
        ids = self.encode_words(work)
        for i, x in zip(new, ids):
            found[i] = x
        if len(known) + len(new) > PIECES:
            self.pieces = {p: f for p, f in zip(pieces, found) if f is not None}
        else:
            known.update((pieces[i], found[i]) for i in new)
        found = [f or b"" for f in found]
        flat = np.frombuffer(b"".join(found), np.int32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        n = np.where(firsts, 0, sizes[codes])
        ends = np.cumsum(n)
        rest = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - ends + n, n)]
        cuts = np.concatenate([[0], ends])[offsets].tolist()
        read = lambda x: np.frombuffer(x, np.int32)
        out = dict(zip([*heads, *whole], map(read, ids[len(new) :])))
        return [out[i] if i in slow else np.concatenate([out[i], rest[cuts[i] : cuts[i + 1]]]) for i in range(len(texts))]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@cache
def trie_encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (the text that the ids give). One pass over the input's own partitions."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_encoder(path)

        def done(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            ids = trie.encode_batch(texts)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            decoded = [trie.decode(x.tolist()) for x in ids]
            return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32())), pa.array(decoded, pa.string())], schema=schema)

        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(ends // BATCH_CHARS)) + 1).tolist(), b.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                part = b.slice(start, stop - start)
                yield done(part.column(0), part.column(1))

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(work, "doc_id long, ids array<int>, decoded string")
