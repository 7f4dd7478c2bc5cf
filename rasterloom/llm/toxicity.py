"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased runs of letters and their beginnings of PREFIXES letters (one stem with many endings
counts as one term), hashed to 2**BITS columns. The machine scores
    b + sum w_i + sum_{i<j} <v_i, v_j>
so a pair of terms (an insult and the mention of a group) can count for more, or less, than the two alone. Weights are given to the
columns that tell the classes apart alone, or as one of a pair where either alone says nothing. It is fitted with numpy on
the driver from a bounded sample of labelled rows (SAMPLE of them and SAMPLE_TERMS terms, by hash of doc_id); only hashed terms come to the driver. Scoring is
one pass without a shuffle. Null and empty texts have no terms and get the bias alone. Of contradicting labels of one doc_id the toxic one
holds; rows with one doc_id count once in fitting, by the greatest of their terms.

scored() replaces columns named score and predicted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, read, small_batches, staged, texts, trim
from .encoding import Cache

BITS, RANK = 18, 8
SAMPLE, SAMPLE_TERMS = 12_000, 32_000_000  # labelled rows that the model is fitted on, and terms of them in all, at most
PREFIXES = (3, 4, 5, 6)
KEPT, GAIN = 2048, 14.0  # columns given weights for themselves, at most, and their least log-likelihood ratio
PAIRED, PAIRS, PAIR_GAIN = 1536, 256, 40.0  # columns of the greatest variance that are tried in pairs; pairs whose columns get weights, at most, and what a pair has to tell beyond its columns
EPOCHS, RATE, DECAY, BATCH = 20, 0.1, 1e-3, 64
TIMES = 3.0  # weight of a toxic row, as they are few
THRESHOLD = 0.7
WORD = regex.compile(r"\p{L}+")


def hashed(word: str) -> bytes:
    """The columns of a word and its beginnings, as little-endian int32. A word and a beginning have different columns."""
    own = [word] + [word[:n] + "-" for n in PREFIXES if n <= len(word)]
    return np.array([zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in own], "<i4").tobytes()


def terms(text: str, known: Cache) -> np.ndarray:
    """The columns of a text's distinct terms, ascending."""
    return np.unique(np.frombuffer(b"".join(map(known.__getitem__, set(WORD.findall(text.lower())))), "<i4"))


@dataclass
class Machine:
    """columns: the kept columns, ascending. bias, weight (n), factor (n, RANK)."""

    columns: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.columns, found)
        at = at[(at < len(self.columns)) & (self.columns[np.minimum(at, len(self.columns) - 1)] == found)] if len(self.columns) else at[:0]
        v = self.factor[at]
        z = self.bias + self.weight[at].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def paired(rows: list[np.ndarray], labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Columns of the pairs that tell the classes apart by being together, beyond what their columns tell alone.

    For two columns the rows fall into four cells, by which of them they hold. The pair's gain is the log-likelihood ratio of the label over the
    four cells less that over each column's two. Cells are counted for all pairs of PAIRED columns by products of matrices, in blocks of rows.
    """
    n, pos = len(rows), float(labels.sum())
    spread = counts * (n - counts)
    top = np.sort(np.argsort(-spread, kind="stable")[:PAIRED])
    top = top[spread[top] > 0]
    if len(top) < 2 or not 0 < pos < n:
        return np.zeros(0, np.int64)
    place = np.full(len(counts), -1, np.int32)
    place[top] = np.arange(len(top))
    both = np.zeros((2, len(top), len(top)), np.float32)
    for i in range(0, n, 1024):
        x = np.zeros((min(1024, n - i), len(top)), np.float32)
        for k, r in enumerate(rows[i : i + 1024]):
            at = place[r]
            x[k, at[at >= 0]] = 1
        for y in (0, 1):
            own = x[(labels[i : i + 1024] > 0) == y]
            both[y] += own.T @ own

    def told(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
        """Log-likelihood of the labels in a cell of so many rows of each kind."""
        toxic, clean = np.maximum(toxic, 0), np.maximum(clean, 0)
        m = toxic + clean + 1e-9
        return toxic * np.log((toxic + 1e-9) / m) + clean * np.log((clean + 1e-9) / m)

    one = both.diagonal(axis1=1, axis2=2)
    alone = told(one[1], one[0]) + told(pos - one[1], n - pos - one[0])
    base = float(told(np.float64(pos), np.float64(n - pos)))
    found = []
    for k in range(len(top)):  # a row of pairs at a time
        t, c = both[1, k, k + 1 :].astype(float), both[0, k, k + 1 :].astype(float)
        a, b, d, e = one[1, k] - t, one[0, k] - c, one[1, k + 1 :] - t, one[0, k + 1 :] - c
        joint = told(t, c) + told(a, b) + told(d, e) + told(pos - t - a - d, n - pos - c - b - e)
        more = 2 * (joint - alone[k] - alone[k + 1 :] + base)
        # a column and another that mostly stands with it (a word and its beginning) tell nothing as a pair
        apart = np.minimum(a + b, d + e) >= 0.05 * np.minimum(one[:, k].sum(), one[:, k + 1 :].sum(0))
        found += [(-more[j], k, k + 1 + j) for j in np.flatnonzero(apart & (more > PAIR_GAIN))]
        if len(found) > 64 * PAIRS:
            found = sorted(found)[:PAIRS]
    chosen = sorted(found)[:PAIRS]
    return np.unique(top[[i for _, a, b in chosen for i in (a, b)]]) if chosen else np.zeros(0, np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Machine:
    """Adagrad on the logistic loss; the same rows in the same order give the same machine."""
    size, n, pos = 1 << BITS, len(rows), max(1, int(labels.sum()))
    neg = max(1, n - pos)
    c1, c0 = (np.bincount(np.concatenate([np.zeros(0, np.int32), *(r for r, y in zip(rows, labels) if (y > 0) == toxic)]), minlength=size) for toxic in (True, False))
    p, q = (c1 + 0.5) / (pos + 1), (c0 + 0.5) / (neg + 1)
    m = (c1 + c0 + 1) / (pos + neg + 2)
    gain = 2 * (pos * (p * np.log(p / m) + (1 - p).clip(1e-9) * np.log((1 - p).clip(1e-9) / (1 - m))) + neg * (q * np.log(q / m) + (1 - q).clip(1e-9) * np.log((1 - q).clip(1e-9) / (1 - m))))
    kept = np.sort(np.argsort(-gain, kind="stable")[:KEPT])
    kept = np.union1d(kept[gain[kept] > GAIN], paired(rows, labels, c0 + c1)).astype(np.int32)
    own = []
    for r in rows:
        at = np.searchsorted(kept, r)
        own.append(at[(at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == r)] if len(kept) else at[:0])
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), RANK)), float(np.log(pos / neg))
    gw, gv, gb = np.full(len(kept), 1e-6), np.full((len(kept), RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            part = order[i : i + BATCH]
            lens = np.array([len(own[k]) for k in part])
            idx = np.concatenate([own[k] for k in part]) if lens.sum() else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(part)), lens)
            vi = v[idx]
            s = np.zeros((len(part), RANK))
            np.add.at(s, row, vi)
            sq = np.bincount(row, (vi**2).sum(1), len(part))
            z = b + np.bincount(row, w[idx], len(part)) + 0.5 * ((s**2).sum(1) - sq)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * np.where(labels[part] > 0, TIMES, 1.0) / len(part)
            used, where = np.unique(idx, return_inverse=True)
            dw = np.bincount(where, err[row], len(used)) + DECAY * w[used] / len(part)
            each = err[row, None] * (s[row] - vi)
            dv = np.stack([np.bincount(where, each[:, f], len(used)) for f in range(RANK)], 1) + DECAY * v[used] / len(part)
            gw[used] += dw**2
            gv[used] += dv**2
            gb += err.sum() ** 2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= 0.2 * RATE * dv / np.sqrt(gv[used])
            b -= RATE * err.sum() / np.sqrt(gb)
    return Machine(kept, float(b), w.astype(np.float32), v.astype(np.float32))


def fold() -> F.Column:
    """crc32 of doc_id as text, mod 3; 1 is held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine fitted on a bounded sample of labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    chosen = labels.where((fold() != 1) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def taken(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cache({}, hashed)
        for b in batches(batches_):
            found = [terms(t, known) for t in texts(b.column("text"))]
            yield pa.record_batch([b.column("doc_id"), b.column("toxic"), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "toxic", "terms"])

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(taken, "doc_id long, toxic int, terms binary")
    once = staged(found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("terms").alias("terms")).withColumn("turn", F.xxhash64(F.lit(2), "doc_id")))  # SAMPLE rows at most
    sums = once.select("turn", "doc_id", (F.length("terms") / 4).cast("long").alias("n")).toPandas().sort_values(["turn", "doc_id"])
    past = sums[sums.n.cumsum() > SAMPLE_TERMS]
    if len(past):  # very long texts: fewer rows
        once = once.where(F.struct("turn", "doc_id") < F.struct(F.lit(int(past.turn.iloc[0])), F.lit(int(past.doc_id.iloc[0]))))
    got = once.select("doc_id", "toxic", "terms").toArrow().sort_by("doc_id")  # bounded as said
    terms_ = [np.frombuffer(t.as_buffer(), np.int32) if t.is_valid else np.zeros(0, np.int32) for chunk in got.column("terms").chunks for t in chunk]
    machine = fit(terms_, np.array(got.column("toxic").to_pylist(), float))
    del got, terms_
    trim()
    return machine


def scored(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score double and predicted int added, or in place of such columns in whatever case; only text is looked at."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    docs = docs.select(*names)

    def score(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cache({}, hashed)
        for b in batches(batches_):
            s = np.array([shared.value.score(terms(t, known)) for t in texts(b.column("text"))])
            yield pa.record_batch([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{schema}, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    machine = train(docs, read(spark, sf_dir, "labels"))
    return scored(docs, machine).select("doc_id", (F.coalesce(fold(), F.lit(0)) == 1).alias("held_out"), "score", "predicted")
