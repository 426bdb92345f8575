"""Bit votes of hashed terms, with built-in functions only.

A 64-bit hash votes on 64 bits. Two bits share a long sum (one in the lower, one in the upper 32 bits), so a document's
votes are 32 sums, which Spark adds up map-side in generated code: no array of terms or bits is kept, and what is shuffled
is one row of sums for each document and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES, BITS = 32, 64
SPACE = r"[\x20\x09-\x0D]+"


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def words_of(text: Column) -> Column:
    """The words between runs of space, tab, line feed, vertical tab, form feed and carriage return."""
    body = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body != "", F.split(body, SPACE)).otherwise(F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are. Texts of one byte a letter take the plain lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingle_at(words: Column, i: Column, k: int) -> Column:
    """The k words from place i on, joined by spaces; fewer where the words end."""
    return F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])


def lane_sums(h: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates: for each lane the (weighted) number of hashes with bit k set, and with bit k + 32 set above it."""
    pick = lambda k: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(4294967297))
    return [F.sum(pick(k) if weight is None else pick(k) * weight).alias(f"lane{k}") for k in range(LANES)]


def fingerprint(total: Column) -> Column:
    """The long whose bits are set where more than half of the total voted for them; 0 without votes."""
    bits = []
    for b in range(BITS):
        lane = F.col(f"lane{b % LANES}")
        count = lane.bitwiseAND(F.lit(0xFFFFFFFF)) if b < LANES else F.shiftrightunsigned(lane, 32)
        bits.append(F.when(count * 2 > total, F.lit(signed(1 << b))).otherwise(F.lit(0).cast("long")))
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_keys(fp: Column, n_blocks: int, agree: int) -> Column:
    """Array of keys, one for each choice of `agree` of n_blocks bit blocks: the choice's number and those blocks' bits.

    Fingerprints that differ in at most n_blocks - agree bits have all bits equal in `agree` blocks at least, so they share
    a key."""
    from itertools import combinations

    edges = [BITS * i // n_blocks for i in range(n_blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(n_blocks), agree)):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        keys.append(F.struct(F.lit(number).alias("table"), fp.bitwiseAND(F.lit(signed(mask))).alias("bits")))
    return F.array(*keys)
