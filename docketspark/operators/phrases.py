"""Lemma searches in one scan: all operands of a query are looked for at once, while a row's words go by.

Shift-And: every word of every operand has a bit of a mask; a state bit is set where the words up to there have just been read in a
row. A word of the text moves all state bits on by one, starts every operand anew, and keeps the bits of those words whose lemmas
it has. The bits of last words that were ever set say which operands the row has. The state is a long that `aggregate` carries
along the row's words, so nothing is joined, exploded or shuffled.

A dictionary is a Column expression from a word to its lemma, or a table of (form, lemma) rows; of a table only the rows that the
query's words need are read, and their forms become part of the plan (MOST at most, else the joins of `lemma` are the way).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lemma_tokens
from .lemma import words_of
from .query import Query, Text, condition, score

#: Bits of a mask, and forms of a query's words that a plan may hold.
BITS, MOST = 62, 20_000
Lemma = Callable[[Column], Column]
Test = Callable[[Column], Column]


def tests_of(words: Sequence[str], dictionary: Lemma | DataFrame | None) -> tuple[Lemma, dict[str, Test]]:
    """(what is done to a text's word, for each query word a test of that). As in `lemma.of_token`, a word that a table of forms
    does not have is looked up as a lemma; without a dictionary words are their own lemmas."""
    if dictionary is None or callable(dictionary):
        of = dictionary or (lambda x: x)
        return of, {w: (lambda x, w=w: x == of(F.lit(w))) for w in words}
    forms = dictionary.select("form", "lemma").distinct()
    own = forms.where(F.col("form").isin(*words)).select(F.col("form").alias("word"), "lemma")
    listed = own.collect()
    lemmas = {w: {r.lemma for r in listed if r.word == w} or {w} for w in words}
    every = sorted(set().union(*lemmas.values())) if lemmas else []
    found = forms.where(F.col("lemma").isin(*every)).limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"the query's words have more than {MOST} forms")
    forms_of = {w: sorted({r.form for r in found if r.lemma in lemmas[w]}) for w in words}
    return (lambda x: x), {w: (lambda x, f=tuple(forms_of[w]): x.isin(*f) if f else F.lit(False)) for w in words}


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _step(bits: dict[str, int], starts: int, every: int, tests: dict[str, Test]) -> Callable[[Column, Column], Column]:
    def step(s: Column, x: Column) -> Column:
        mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(tests[w](x), _long(b)).otherwise(_long(0)) for w, b in bits.items()])
        now = F.shiftleft(s["now"], 1).bitwiseOR(_long(starts)).bitwiseAND(mask)
        return F.struct(now.alias("now"), s["ever"].bitwiseOR(now.bitwiseAND(_long(every))).alias("ever"))

    return step


def seen(words: Column, phrases: Sequence[Sequence[str]], tests: dict[str, Test]) -> list[Column]:
    """For each phrase whether its words follow each other in the array of words (an empty phrase is nowhere)."""
    groups: list[list[int]] = []
    room = 0
    for i, p in enumerate(phrases):
        if len(p) > BITS:
            raise ValueError(f"a phrase has more than {BITS} words")
        if not groups or room + len(p) > BITS:
            groups.append([])
            room = 0
        groups[-1].append(i)
        room += len(p)
    out: dict[int, Column] = {}
    for group in groups:
        bits: dict[str, int] = {}
        starts, at, ends = 0, 0, {}
        for i in group:
            if phrases[i]:
                starts |= 1 << at
                for w in phrases[i]:
                    bits[w] = bits.get(w, 0) | 1 << at
                    at += 1
                ends[i] = 1 << (at - 1)
        every = reduce(lambda a, b: a | b, ends.values(), 0)
        ever = F.aggregate(words, F.struct(_long(0).alias("now"), _long(0).alias("ever")), _step(bits, starts, every, tests), lambda s: s["ever"]) if bits else _long(0)
        for i in group:
            out[i] = ever.bitwiseAND(_long(ends[i])) != 0 if i in ends else F.lit(False)
    return [out[i] for i in range(len(phrases))]


def operands(t: Text) -> list[list[str]]:
    """The phrases of a text operand, which all have to occur: its words in order where it is quoted, else each of them."""
    words = words_of(t.raw)
    return [words] if t.quoted and len(words) > 1 else [[w] for w in words]


def _words(text: str, of: Lemma) -> Column:
    return F.transform(lemma_tokens(text), of)


def rows_with(rows: DataFrame, phrases: Sequence[Sequence[str]], dictionary: Lemma | DataFrame | None = None, text: str = "text") -> DataFrame:
    """The rows that have all phrases (lists of words), by lemma."""
    of, tests = tests_of(sorted({w for p in phrases for w in p}), dictionary)
    words = _words(text, of)
    return rows.where(reduce(lambda a, b: a & b, seen(words, phrases, tests), F.lit(True)))


def search(index: DataFrame, query: Query, dictionary: Lemma | DataFrame | None = None, text: str = "text") -> DataFrame:
    """Index rows that the query matches with its texts read as lemmas, and their score."""
    texts = list(dict.fromkeys(query.texts))
    phrases = [operands(t) for t in texts]
    of, tests = tests_of(sorted({w for ps in phrases for p in ps for w in p}), dictionary)
    flat = [p for ps in phrases for p in ps]
    found = iter(seen(_words(text, of), flat, tests))
    flags = {t: reduce(lambda a, b: a & b, [next(found) for _ in ps], F.lit(bool(ps))) for t, ps in zip(texts, phrases)}
    return index.where(condition(query, text=lambda t: F.coalesce(flags[t], F.lit(False)))).withColumn("score", score(query))
