"""Toxicity scores from a convolutional text classifier that is trained in numpy.

A word's vector is the sum of three rows of one hashed table: two hashes of the word (a clash in one is no clash in the
other) and one of its first five letters. Filters of widths 1, 2 and 3 slide over all words of the text, each keeps its
largest response, and a logistic layer reads those. All labelled documents (whole texts) are trained on, in shards of about SHARD
documents: in each round every shard goes on from the common network with Adam, as a task of its own, and Spark averages what the
shards have learnt (rows of the table over the shards that met them). Rows of the table that training never met are zero, so
unknown words say nothing. The table's first column starts from the words' log-odds over all documents, which Spark counts.

Thresholds are calibrated by language: a table of word hashes tells the language from the text, and on a fifth of all labelled
documents that training leaves out the best cut of each language is found, to a thousandth; scores are shifted so that every
language's cut is at 0.5. Only tables of fixed size (counts by table row, chunks of the averaged table, counts by score) go to the
driver.
The lang column serves as a target of that table in training; scoring reads the text alone.

Null and empty texts are scored as texts without words (the layer's bias). Without labels of both kinds every score is 0.
Repeated rows give repeated results. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

TABLE_BITS, DIM, FILTERS, WIDTHS = 17, 8, 8, (1, 2, 3)
SHARD = 2500  # documents that a task trains on, about
BATCH, RATE, DECAY = 32, 0.01, 1e-4
#: Passes over all documents: fewer where there are many, so that STEPS documents are seen at least if MOST_PASSES allow it.
LEAST_PASSES, MOST_PASSES, STEPS = 2, 6, 18_000
ROUNDS = 2  # the shards' networks are averaged so often
CHUNKS = 128  # parts of the table that are averaged each on its own
LEAST_CALIBRATED = 8  # documents of either label that a language's own threshold takes
WORD = re.compile(r"[^\W\d_]+")
MEMORY = 300_000  # words whose hashes a worker remembers
CHUNK = 400_000  # characters that are scored at once


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


class Hashes(dict):
    """word -> its three rows, packed in one integer."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        a, b, mask = crc(word), crc(word[:5] + " "), (1 << TABLE_BITS) - 1
        out = self[word] = a & mask | (a * 0x9E3779B97F4A7C15 >> 40 & mask) << 20 | (b & mask) << 40
        return out


def rows_of(texts: list[str], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """((words, 3) table rows, number of words of each text)."""
    packed, sizes = [], []
    for t in texts:
        words = WORD.findall(t.lower())
        packed.append(np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
    flat = np.concatenate(packed) if packed else np.zeros(0, np.int64)
    mask = (1 << 20) - 1
    return np.stack([flat & mask, flat >> 20 & mask, flat >> 40], 1), np.array(sizes, np.int64)


@dataclass
class Network:
    table: np.ndarray  # (rows, DIM)
    filters: list[np.ndarray]  # for each width (width * DIM, FILTERS)
    layer: np.ndarray  # (widths * FILTERS,)
    bias: float
    tongue: np.ndarray  # (rows, languages): log-odds of a word's first hash
    shift: np.ndarray  # threshold for each language, and for no known one at the end

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]]

    def pooled(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((documents, filters) largest responses above 0, where they begin; -1 for none). Windows stay in their document."""
        out = np.zeros((len(starts), len(WIDTHS) * FILTERS), np.float32)
        place = np.full(out.shape, -1, np.int64)
        for j, w in enumerate(WIDTHS):
            part = slice(j * FILTERS, (j + 1) * FILTERS)
            long = np.flatnonzero(ends - starts >= w)
            if not len(long) or len(x) < w:
                continue
            response = x[: len(x) - w + 1] @ self.filters[j][:DIM]
            for k in range(1, w):
                response += x[k : len(x) - w + 1 + k] @ self.filters[j][k * DIM : (k + 1) * DIM]
            for d in long.tolist():
                own = response[starts[d] : ends[d] - w + 1]
                at = own.argmax(0)
                top = own[at, np.arange(FILTERS)]
                out[d, part] = np.maximum(top, 0)
                place[d, part] = np.where(top > 0, at + starts[d], -1)
        return out, place

    def strongest(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The largest responses alone, of all documents at once."""
        out = np.zeros((len(sizes), len(WIDTHS) * FILTERS), np.float32)
        ends = np.cumsum(sizes)
        for j, w in enumerate(WIDTHS):
            if len(x) < w:
                continue
            n = len(x) - w + 1
            response = self.filters[j][:DIM].T @ x[:n].T
            for k in range(1, w):
                response += self.filters[j][k * DIM : (k + 1) * DIM].T @ x[k : n + k].T
            for k in range(1, w):  # windows that reach into the next document
                over = ends - k
                response[:, over[(over >= 0) & (over < n)]] = 0
            full = np.flatnonzero(sizes)
            starts = (ends - sizes)[full]
            inside = starts < n
            out[full[inside], j * FILTERS : (j + 1) * FILTERS] = np.maximum(np.maximum.reduceat(response, starts[inside], axis=1), 0).T
        return out

    def raw(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logit, language) of documents."""
        ends = np.cumsum(sizes)
        best = self.strongest(self.vectors(rows), sizes)
        language = np.full(len(sizes), self.tongue.shape[1])
        if self.tongue.shape[1]:
            sums = np.concatenate([np.zeros((1, self.tongue.shape[1])), np.cumsum(self.tongue[rows[:, 0]], 0, dtype=np.float64)])
            votes = sums[ends] - sums[ends - sizes]
            language = np.where(sizes > 0, votes.argmax(1), language)
        return best @ self.layer + self.bias, language

    def score(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        logit, language = self.raw(rows, sizes)
        return 1 / (1 + np.exp(-np.clip(logit - self.shift[language], -30, 30)))


def log_odds(one: np.ndarray, all_: np.ndarray, positive: int, n: int) -> np.ndarray:
    """For each table row the log-odds that a document with it (one of all_) has label 1 (positive of n), shrunk towards 0."""
    p, total = (one + 0.5) / (positive + 1), (all_ - one + 0.5) / (n - positive + 1)
    return np.where(all_ >= 3, np.log(p / total), 0) * all_ / (all_ + 20)


def ordered(batches: Iterator[pa.RecordBatch]) -> tuple[list[str], np.ndarray, list[str | None], np.ndarray]:
    """(texts, labels, languages, left out) of a shard."""
    found = [b.select(["text", "y", "lang", "left_out"]) for b in batches]
    t = pa.Table.from_batches(found) if found else pa.table({"text": [], "y": [], "lang": [], "left_out": []})
    return t["text"].to_pylist(), np.array(t["y"].to_pylist(), float), t["lang"].to_pylist(), np.array(t["left_out"].to_pylist(), bool)


def _held(net: Network, spark) -> object:
    """The network as a broadcast: a few MB whatever the data."""
    return spark.sparkContext.broadcast(pickle.dumps(net))


def started(shards: DataFrame, names: list[str], sizes: dict[tuple[bool, int], int], languages: dict[str, int], seed: int) -> Network:
    """A network before training: the words' log-odds by label and by language over all documents, and random filters."""
    n = 1 << TABLE_BITS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, langs, left_out = ordered(batches)
        rows, size = rows_of(texts, Hashes())
        doc = np.repeat(np.arange(len(y)), size)
        for j in range(3):
            at, of = np.divmod(np.unique(rows[:, j] * max(len(y), 1) + doc), max(len(y), 1))
            inside = ~left_out[of]
            kinds = [("all", np.bincount(at[inside], minlength=n)), ("one", np.bincount(at[inside], y[of][inside], n))]
            if j == 0:
                lang = np.array(langs, object)
                kinds += [("docs", np.bincount(at, minlength=n))] + [(f"lang {k}", np.bincount(at, lang[of] == name, n)) for k, name in enumerate(names)]
            for kind, value in kinds:
                parts = value.astype(np.int32).reshape(CHUNKS, -1)
                for c in np.flatnonzero(parts.any(1)).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([f"{kind} {j}"]), pa.array([c], pa.int32()), pa.array([parts[c].tobytes()], pa.binary())], names=["kind", "chunk", "n"])

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for b in batches for x in b.column("n"))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["kind", "chunk", "n"])

    counts = "kind string, chunk int, n binary"
    counted: dict[str, np.ndarray] = {}
    for r in shards.mapInArrow(work, counts).groupBy("kind", "chunk").applyInArrow(added, counts).toLocalIterator():
        counted.setdefault(r.kind, np.zeros((CHUNKS, n // CHUNKS)))[r.chunk] = np.frombuffer(bytes(r.n), np.int64)

    def full(kind: str) -> np.ndarray:
        return counted[kind].ravel() if kind in counted else np.zeros(n)

    rng = np.random.default_rng(seed)
    table = np.zeros((n, DIM), np.float32)
    every = [full(f"all {j}") for j in range(3)]
    met = np.flatnonzero(sum(every))
    table[met] = rng.normal(0, 0.05, (len(met), DIM))
    trained, positive = sizes.get((False, 0), 0) + sizes.get((False, 1), 0), sizes.get((False, 1), 0)
    for j in range(3):
        table[:, 0] += log_odds(full(f"one {j}"), every[j], positive, trained).astype(np.float32) / 3
    tongue = np.zeros((n, len(names)), np.float32)
    docs, total = full("docs 0"), sum(sizes.values())
    for k, name in enumerate(names):
        tongue[:, k] = log_odds(full(f"lang {k} 0"), docs, languages[name], total) if len(names) > 1 else 0
    filters = [rng.normal(0, 0.2, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[::DIM] = np.abs(f[::DIM])
    rate = min(max(positive / max(trained, 1), 1e-6), 1 - 1e-6)
    return Network(table, filters, np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), float(np.log(rate / (1 - rate))), tongue, np.zeros(len(names) + 1))


def fit(net: Network, texts: list[str], y: np.ndarray, rate: float, passes: int, seed: int) -> None:
    """Goes on training a network on a shard's documents. rate: the share of label 1 among all."""
    if not texts:
        return
    rng = np.random.default_rng(seed)
    rows, sizes = rows_of(texts, Hashes())
    ends = np.cumsum(sizes)
    starts, order = ends - sizes, np.arange(len(y))
    moments: dict = {}
    weight = np.where(y == 1, 0.5 / max(rate, 1e-6), 0.5 / max(1 - rate, 1e-6))

    def adam(key, value: np.ndarray, grad: np.ndarray, step: int) -> None:
        m, v = moments.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= RATE * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) + DECAY * value)

    step, bias = 0, np.array([net.bias], np.float32)
    for _ in range(passes):
        rng.shuffle(order)
        for i in range(0, len(order), BATCH):
            step += 1
            pick = order[i : i + BATCH]
            at = np.concatenate([np.arange(starts[d], ends[d]) for d in pick])
            own, size = rows[at], sizes[pick]
            e = np.cumsum(size)
            x = net.vectors(own)
            best, place = net.pooled(x, e - size, e)
            error = (weight[pick] * (1 / (1 + np.exp(-np.clip(best @ net.layer + bias[0], -30, 30))) - y[pick]) / len(pick)).astype(np.float32)
            back = error[:, None] * net.layer[None, :] * (place >= 0)
            slope = np.zeros_like(x)
            for j, w in enumerate(WIDTHS):
                grad = np.zeros_like(net.filters[j])
                for f in range(FILTERS):
                    c = j * FILTERS + f
                    d = np.flatnonzero(place[:, c] >= 0)
                    for k in range(w):
                        p = place[d, c] + k
                        grad[k * DIM : (k + 1) * DIM, f] += back[d, c] @ x[p]
                        np.add.at(slope, p, back[d, c][:, None] * net.filters[j][k * DIM : (k + 1) * DIM, f])
                adam(("filter", j), net.filters[j], grad, step)
            adam("layer", net.layer, error @ best, step)
            adam("bias", bias, np.array([error.sum()], np.float32), step)
            touched = np.flatnonzero(slope.any(1))
            # The table moves by plain steps where it was read: most of its rows are never touched.
            for j in range(3):
                np.add.at(net.table, own[touched, j], -RATE * 20 * slope[touched])
    net.bias = float(bias[0])


def _small(net: Network) -> np.ndarray:
    return np.concatenate([*(f.ravel() for f in net.filters), net.layer, [net.bias]]).astype(np.float64)


def averaged(shards: DataFrame, net: Network, rate: float, passes: int, seed: int) -> Network:
    """The network after one round: each shard trains from net in a task, and the mean of the changes is added."""
    held = _held(net, shards.sparkSession)
    size = (1 << TABLE_BITS) // CHUNKS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, _, left_out = ordered(batches)
        own = pickle.loads(held.value)
        before, small = own.table.copy(), _small(own)
        keep = np.flatnonzero(~left_out)
        if not len(keep):
            return
        fit(own, [texts[i] for i in keep], y[keep], rate, passes, seed)
        moved = (own.table - before).astype(np.float16).reshape(CHUNKS, -1)
        for c in np.flatnonzero(moved.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([moved[c].tobytes()], pa.binary())], names=["chunk", "moved"])
        change = np.append((_small(own) - small) * len(keep), len(keep))
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([change.tobytes()], pa.binary())], names=["chunk", "moved"])

    def mean(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = 0.0, 0
        for b in batches:
            for x in b.column("moved"):
                if key[0].as_py() < 0:
                    total = total + np.frombuffer(x.as_py(), np.float64)
                else:
                    one = np.frombuffer(x.as_py(), np.float16).astype(np.float64).reshape(-1, DIM)
                    total, met = total + one, met + one.any(1)
        out = total[:-1] / total[-1] if key[0].as_py() < 0 else (total / np.maximum(met, 1)[:, None]).astype(np.float32).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["chunk", "moved"])

    made = shards.mapInArrow(work, "chunk int, moved binary").groupBy("chunk").applyInArrow(mean, "chunk int, moved binary")
    for r in made.toLocalIterator():
        if r.chunk < 0:
            small, at = _small(net) + np.frombuffer(bytes(r.moved), np.float64), 0
            for f in net.filters:
                f[:] = small[at : at + f.size].reshape(f.shape)
                at += f.size
            net.layer[:] = small[at:-1]
            net.bias = float(small[-1])
        else:
            net.table[r.chunk * size : (r.chunk + 1) * size] += np.frombuffer(bytes(r.moved), np.float32).reshape(-1, DIM)
    held.destroy()
    return net


def cut(z: np.ndarray, zero: np.ndarray, one: np.ndarray) -> float:
    """The threshold with the largest balanced accuracy: the middle of the widest best gap. zero, one: documents of each label
    at each z."""
    o = np.argsort(z, kind="stable")
    z, zero, one = z[o], zero[o], one[o]
    right = np.concatenate([[0], np.cumsum(zero)]) / max(zero.sum(), 1) + np.concatenate([np.cumsum(one[::-1])[::-1], [0]]) / max(one.sum(), 1)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    b = best[(edges[best + 1] - edges[best]).argmax()]
    return float((edges[b] + edges[b + 1]) / 2)


def calibrated(shards: DataFrame, net: Network) -> Network:
    """The network with thresholds from all documents that training left out (from all, if those have one label)."""
    held = _held(net, shards.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = pickle.loads(held.value), Hashes()
        for b in batches:
            texts, y, _, left_out = ordered(iter([b]))
            for i in range(0, len(texts), 64):
                part = slice(i, i + 64)
                logit, language = own.raw(*rows_of(texts[part], hashes))
                at = np.round(np.clip(logit, -30, 30) * 1000).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(left_out[part]), pa.array(language.astype(np.int32)), pa.array(at), pa.array(y[part].astype(np.int32))], names=["left_out", "language", "at", "y"])

    def counts(rows: DataFrame) -> np.ndarray:
        t = rows.groupBy("language", "at").agg(F.count_if(F.col("y") == 0).alias("zero"), F.count_if(F.col("y") == 1).alias("one")).orderBy("language", "at").toArrow()  # 60,001 scores a language at most
        return np.array([t[c].to_pylist() for c in ("language", "at", "zero", "one")], float)

    scored = lambda rows: rows.mapInArrow(work, "left_out boolean, language int, at int, y int")
    language, at, zero, one = counts(scored(shards.where("left_out")))
    if zero.sum() and one.sum():
        net.shift[:] = cut(at / 1000, zero, one)
        for k in range(len(net.shift) - 1):
            own = language == k
            if min(zero[own].sum(), one[own].sum()) >= LEAST_CALIBRATED:
                net.shift[k] = cut(at[own] / 1000, zero[own], one[own])
    else:
        _, at, zero, one = counts(scored(shards))
        net.shift[:] = cut(at / 1000, zero, one)
    held.destroy()
    return net


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, label_column: str, lang_column: str | None, number: int | None = None) -> DataFrame:
    """doc_id, text, lang, y, left_out of all usable labelled documents; dealt to `number` shards by doc_id."""
    known = labels.select("doc_id", F.col(label_column).cast("int").alias("y")).where(usable & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    lang = F.col(lang_column).cast("string") if lang_column and lang_column in docs.columns else F.lit(None).cast("string")
    texts = docs.where(usable).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    if number is None:
        rows = texts.join(known, "doc_id")
    else:  # texts and labels go to their shard once, and meet there
        none = lambda kind: F.lit(None).cast(kind)
        both = texts.select("*", none("int").alias("y")).union(known.select("doc_id", none("string"), none("string"), "y")).repartition(number, "doc_id")
        met = both.withColumn("ys", F.collect_list("y").over(Window.partitionBy("doc_id")))
        rows = met.where("text is not null").select("doc_id", "text", "lang", F.explode("ys").alias("y"))
    return rows.withColumn("left_out", F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(5)) == 0)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_column: str = "toxic", lang_column: str | None = "lang", seed: int = 7) -> Network | None:
    """A network from all usable labelled documents; None without both labels. Their texts are stored once, dealt to shards by
    doc_id."""
    rows = labelled(docs, labels, usable, label_column, lang_column)
    sizes: dict[tuple[bool, int], int] = {}
    languages: dict[str, int] = {}
    for r in rows.groupBy("left_out", "y", "lang").count().collect():  # some rows for each language
        sizes[r.left_out, r.y] = sizes.get((r.left_out, r.y), 0) + r["count"]
        if r.lang is not None:
            languages[r.lang] = languages.get(r.lang, 0) + r["count"]
    if len({y for _, y in sizes}) < 2:
        return None
    trained = sizes.get((False, 0), 0) + sizes.get((False, 1), 0)
    shared_dir(docs.sparkSession)
    number = max(1, -(-trained // SHARD))
    shards = labelled(docs, labels, usable, label_column, lang_column, number).sortWithinPartitions("doc_id", "text").checkpoint()
    net = started(shards, sorted(languages), sizes, languages, seed)
    rate = sizes.get((False, 1), 0) / max(trained, 1)
    passes = min(MOST_PASSES, max(LEAST_PASSES, -(-STEPS // max(trained, 1))))
    for r in range(ROUNDS):
        net = averaged(shards, net, rate, passes // ROUNDS + (r < passes % ROUNDS), seed + r)
    return calibrated(shards, net)


def score(docs: DataFrame, net: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score (0 to 1). One pass over the input's own partitions."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            start, out, texts, size = 0, [], [], 0
            for text in b.column(1):
                texts.append(text.as_py())
                size += len(texts[-1])
                if size > CHUNK:
                    out.append(net.score(*rows_of(texts, hashes)))
                    texts, size = [], 0
            if texts:
                out.append(net.score(*rows_of(texts, hashes)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], schema=schema)

    return rows.mapInArrow(work, "doc_id long, score double")
