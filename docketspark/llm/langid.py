"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed letter trigrams. A document is taken as a mixture of languages: expectation-
maximisation finds the proportions under which its trigrams are most likely. The set of languages is selected by penalised
likelihood: from the best single language on, the next by proportion joins as long as that raises the log-likelihood by
more than PENALTY for each trigram (and half the logarithm of their number). The prediction is the set's largest share.

Trigrams are of the lower-cased text, all that is no letter standing for one blank; their middle is a letter. Distributions
are learnt from a sample of at most about SAMPLE labelled documents of each language, whose whole texts are counted on the
executors; the driver gets one number for each language and hash bucket.

A null text, or one without a letter, is `und` with score 0. So is every text when there is nothing to learn from. Repeated
rows give repeated results. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

UND = "und"
BUCKETS, SMOOTH = 4096, 0.5
SAMPLE = 2000  # labelled documents of each language, about
STEPS, PENALTY, LEAST_SHARE = 10, 0.02, 0.05
DOCS, CHARS = 64, 400_000  # of a batch


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigrams(texts: list[str]) -> np.ndarray:
    """(texts, BUCKETS) counts."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("  " + "  ".join(lowered) + "  ").encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(letters()[codes], codes, np.uint32(32))
    ends = np.cumsum([len(t) + 2 for t in lowered])
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    hashed = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(20)
    at = np.flatnonzero(b != 32)
    doc = np.searchsorted(ends, at, "right")
    return np.bincount(doc * BUCKETS + hashed[at], minlength=len(texts) * BUCKETS)[: len(texts) * BUCKETS].reshape(len(texts), BUCKETS)


@dataclass
class Model:
    languages: list[str]
    p: np.ndarray  # (languages, BUCKETS)
    prior: np.ndarray

    def mixture(self, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shares, log-likelihood) after EM from these shares; a share of 0 stays 0."""
        n, share = counts.sum(1, keepdims=True), start
        for _ in range(STEPS):
            share = share * ((counts / (share @ self.p)) @ self.p.T) / n
        return share, (counts * np.log(share @ self.p)).sum(1)

    def infer(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shares of the selected languages, score); rows have a trigram at least."""
        counts = counts.astype(np.float32)
        n, size = counts.sum(1), len(self.languages)
        single = counts @ np.log(self.p).T + np.log(self.prior)
        order = np.argsort(-single, 1, kind="stable")
        best = order[:, 0]
        share = np.eye(size, dtype=np.float32)[best]
        fit = single[np.arange(len(n)), best]
        even = np.exp((single - fit[:, None]) / n[:, None] * np.minimum(n, 30)[:, None])
        sure = 1 / even.sum(1)
        if size > 1:
            full, _ = self.mixture(counts, np.full((len(n), size), 1 / size, np.float32))
            rank = np.argsort(np.argsort(-full, 1, kind="stable"), 1, kind="stable")
            growing = np.arange(len(n))
            for k in range(2, size + 1):
                growing = growing[np.sort(full[growing], 1)[:, -k] >= LEAST_SHARE]
                if not len(growing):
                    break
                start = (rank[growing] < k) / np.float32(k)
                wider, better = self.mixture(counts[growing], start)
                gain = better - fit[growing] > PENALTY * n[growing] + 0.5 * np.log(n[growing])
                growing, wider, better = growing[gain], wider[gain], better[gain]
                share[growing], fit[growing] = wider, better
        return share, share.max(1) * sure


def sampled(docs: DataFrame, lang: str, sample: int, usable: Column) -> DataFrame:
    """At most about `sample` usable rows of each language, chosen by a hash of doc_id."""
    rows = docs.where(usable & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row for each language
    if not counts:
        return rows.limit(0)
    odds = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) < F.element_at(odds, F.col(lang)) * (1 << 30))


def train(docs: DataFrame, usable: Column, sample: int = SAMPLE, text_column: str = "text", lang_column: str = "lang") -> Model:
    rows = sampled(docs.select("doc_id", text_column, lang_column), lang_column, sample, usable)
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                sums[lang] = sums.get(lang, 0) + trigrams([text.as_py()])[0]
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], schema=schema)

    counted = rows.select(F.col(lang_column).cast("string").alias("lang"), F.coalesce(text_column, F.lit("")).alias("text")).mapInArrow(count, "lang string, bucket int, n long")
    totals = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in totals})
    p = np.full((len(languages), BUCKETS), SMOOTH)
    for r in totals:
        p[languages.index(r.lang), r.bucket] += r.n
    prior = p.sum(1) / p.sum() if len(languages) else np.zeros(0)
    return Model(languages, (p / p.sum(1, keepdims=True)).astype(np.float32), prior.astype(np.float32))


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[str | None]]:
    """(language, score, mixture) of each text."""
    return predictions(texts, model)[:3]


def predictions(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[str | None], list[float]]:
    """(language, score, mixture, the language's share) of each text."""
    pred, score, mixed, shares = [UND] * len(texts), [0.0] * len(texts), [None] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return pred, score, mixed, shares
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and stop - start < DOCS and (size < CHARS or stop == start):
            size += len(texts[stop] or "")
            stop += 1
        counts = trigrams([t or "" for t in texts[start:stop]])
        at = np.flatnonzero(counts.any(1))
        if len(at):
            share, sure = model.infer(counts[at])
            for i, s, q in zip(at.tolist(), share, sure.tolist()):
                pred[start + i], score[start + i] = model.languages[int(s.argmax())], min(1.0, max(0.0, q))
                shares[start + i] = float(s.max())
                mixed[start + i] = ",".join(f"{model.languages[k]}:{s[k]:.2f}" for k in np.argsort(-s, kind="stable") if s[k] > 0)
        start = stop
    return pred, score, mixed, shares


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """All columns of docs with lang_pred, score (share of the predicted language times how sure the choice is), mixture
    (`en:0.80,fr:0.20`) and share (of the predicted language); columns of these names are replaced."""
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("mixture", T.StringType()), ("share", T.DoubleType())]
    docs = docs.drop(*[k for k, _ in added])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, t) for k, t in added]])
    place = docs.columns.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, mixed, shares = predictions(b.column(place).to_pylist(), model)
            columns = [*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.string()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, *[k for k, _ in added]])

    return docs.mapInArrow(lean(work), schema)
