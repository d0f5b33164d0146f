"""Two document classifiers trained in numpy on the driver and applied to Arrow batches on the executors.

Both learn from a bounded sample of labelled rows (`bound`), whose features are computed on the executors;
everything else runs over all documents. Texts are scored whole, in parts of bounded size.

Defined results: null or empty texts get the score of a document without features; rows without an id are
scored, but not learned from (`held_out` is null for them); of several labels for one id the mean counts,
1 from 0.5 on; without any label every score is 0. Equal texts get equal scores. Other columns of the tables
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import hashing
from tessera.llm.token_files import slices
from tessera.runtime import map_arrow, table

BITS = 20
SAME_AGAIN = 0


def bucket(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def stems(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of each word and of its first 4, 5 and 6 bytes."""
    for w in hashing.words(texts, hashing.LETTERS):
        for found in (w.hashes(), *(hashing.mix(w.hashes(k) + np.uint64(k)) for k in (4, 5, 6))):
            yield w.text, bucket(found)


def word_pairs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of each word or run of marks, and of each two in a row; of a word said twice also the pair "same again"."""
    last = np.full(1, -1), np.zeros(1, np.uint64)
    for w in hashing.words(texts, hashing.LETTERS_AND_MARKS):
        if not len(w.text):
            continue
        found = w.hashes()
        yield w.text, bucket(found)
        text, own = np.concatenate([last[0], w.text]), np.concatenate([last[1], found])
        same = text[1:] == text[:-1]
        yield text[1:][same], bucket(hashing.joined(own[:-1], own[1:])[same])
        again = text[1:][same & (own[1:] == own[:-1])]
        yield again, np.full(len(again), SAME_AGAIN)
        last = text[-1:], own[-1:]


def counted(texts: pa.Array, features: Callable, keep: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket), their counts, and the number of features of each text; keep: of a bucket, whether it counts."""
    keys, total = [np.zeros(0, np.int64)], np.zeros(len(texts))
    for text, b in features(texts):
        total += np.bincount(text, minlength=len(texts))
        if keep is not None:
            text, b = text[keep(b)], b[keep(b)]
        keys.append(text << BITS | b)
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    return found >> BITS, found & ((1 << BITS) - 1), counts, total


def within(hashed: Column, rows: int, bound: int) -> Column:
    """True for about `bound` of `rows` rows, by hash; for all if there are no more."""
    return F.lit(True) if rows <= bound else F.pmod(hashed, F.lit(1 << 30)) < int((1 << 30) * bound / rows)


def labels_of(labels: DataFrame, label: str) -> DataFrame:
    """One row for each id: id, y (0 or 1)."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy(F.col("doc_id").alias("id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))


def training_features(rows: DataFrame, features: Callable) -> pa.Table:
    """y, buckets, counts (packed), n: of rows (text, y), a bounded number."""

    def pack(batches):
        for batch in (part for whole in batches for part in slices(whole, 0)):
            text, b, counts, total = counted(batch.column(0), features)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
            packed = [(b[i:j].astype("<i4").tobytes(), np.minimum(counts[i:j], 65535).astype("<u2").tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch(
                [batch.column(1).cast(pa.int32()), pa.array([x for x, _ in packed], pa.binary()), pa.array([x for _, x in packed], pa.binary()), pa.array(total)],
                ["y", "buckets", "counts", "n"],
            )

    return map_arrow(rows, pack, "y int, buckets binary, counts binary, n double").toArrow()


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """y, n of rows; row, bucket, count of their features."""
    buckets = [np.frombuffer(x, "<i4") for x in rows["buckets"].to_pylist()]
    counts = [np.frombuffer(x, "<u2") for x in rows["counts"].to_pylist()]
    row = np.repeat(np.arange(len(buckets)), [len(x) for x in buckets])
    empty = np.zeros(0, np.int64)
    return rows["y"].to_numpy(), rows["n"].to_numpy(), row, np.concatenate([empty, *buckets]).astype(np.int64), np.concatenate([empty, *counts]).astype(np.float64)


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every row."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            yield pa.record_batch([batch.column(0), pa.array(score(batch.column(1)))], ["doc_id", "score"])

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, score double")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


# ---- toxicity: non-negative positive-unlabelled learning


@dataclass
class ToxicityModel:
    """Logistic over log2(1 + count) of selected words and stems."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if not np.isfinite(self.bias):
            return np.zeros(len(texts))
        weight = np.zeros(1 << BITS, np.float32)
        weight[self.buckets] = self.weights
        text, b, counts, _ = counted(texts, stems, lambda x: weight[x] != 0)
        return sigmoid(self.bias + np.bincount(text, weights=weight[b] * np.log2(1 + counts), minlength=len(texts)))


def train_nnpu(y, row, b, counts, prior: float, most: int = 2000, rounds: int = 200, rate: float = 0.1, decay: float = 3e-4) -> ToxicityModel:
    """Positives (y = 1) against unlabelled rows (y = 0), of which a share of `prior` is taken to be positive.

    The risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); where the second part falls below zero its
    gradient is reversed. Features are those found in positives significantly more often than in unlabelled rows, and by the
    prior more often in positive rows than in others.
    """
    positive, unlabelled = y == 1, y == 0
    n_p, n_u = int(positive.sum()), int(unlabelled.sum())
    if not n_p or not n_u or not 0 < prior < 1:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.float32), -np.inf)
    in_p, in_u = (np.bincount(b[m[row]], minlength=1 << BITS) for m in (positive, unlabelled))
    share_p, share_u = in_p / n_p, in_u / n_u
    lift = (share_p - share_u) / np.sqrt(np.maximum(share_u * (1 - share_u), 1e-9) / n_p + 1e-12)
    lift[(in_p < 4) | (prior * share_p < 0.5 * share_u)] = 0
    chosen = np.flatnonzero(lift >= 5)
    chosen = np.sort(chosen[np.argsort(-lift[chosen], kind="stable")[:most]])
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[b] >= 0
    row, at, x = row[kept], place[b[kept]], np.log2(1 + counts[kept])
    w = np.zeros(len(chosen) + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        z = np.bincount(row, weights=x * w[at], minlength=len(y)) + w[-1]
        p = sigmoid(z)
        negative_part = np.logaddexp(0, z[unlabelled]).mean() - prior * np.logaddexp(0, z[positive]).mean()
        negative = np.where(unlabelled, p / n_u, -prior * p / n_p)
        step = np.where(positive, prior * (p - 1) / n_p, 0) + negative if negative_part >= 0 else -negative
        gradient = np.append(np.bincount(at, weights=x * step[row], minlength=len(chosen)) + decay * w[:-1], step.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        w -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return ToxicityModel(chosen, w[:-1].astype(np.float32), float(w[-1]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learnable: Column, positives: int = 4000, unlabelled: int = 8000, label: str = "toxic") -> ToxicityModel:
    """Learn from `docs` (doc_id, text) where `learnable`, a condition on doc_id: labelled positives, and rows without a look at labels."""
    known = labels_of(labels, label).filter(F.col("id").isNotNull()).withColumn("doc_id", F.col("id"))
    known = known.filter(learnable).drop("doc_id")
    count = known.agg(F.count("y").alias("n"), F.sum("y").alias("p")).first()
    if not count["n"] or not count["p"]:
        return train_nnpu(np.zeros(0), np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0)
    hashed = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    pool = docs.filter(learnable & F.col("doc_id").isNotNull())
    bad = pool.join(known.filter("y = 1").filter(within(F.xxhash64(F.col("id"), F.lit("p")), count["p"], positives)), F.col("doc_id") == F.col("id"), "left_semi")
    size = pool.select("doc_id").count()
    rows = bad.select("text", F.lit(1).alias("y")).union(pool.filter(within(hashed, size, unlabelled)).select("text", F.lit(0).alias("y")))
    y, _, row, b, counts = unpacked(training_features(rows, stems))
    return train_nnpu(y, row, b, counts, count["p"] / count["n"])


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda texts: shared.value(texts))


def op6_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = toxicity_scores(docs, fit_toxicity(docs, labels, ~held))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# ---- quality: follow the regularised leader


@dataclass
class QualityModel:
    """Logistic over the shares of hashed words and word pairs."""

    weights: np.ndarray
    bias: float
    scale: float

    def __call__(self, texts: pa.Array) -> np.ndarray:
        dot, n = np.zeros(len(texts)), np.zeros(len(texts))
        for text, b in word_pairs(texts):
            dot += np.bincount(text, weights=self.weights[b], minlength=len(texts))
            n += np.bincount(text, minlength=len(texts))
        if not np.isfinite(self.bias):
            return np.zeros(len(texts))
        return sigmoid(self.bias + self.scale * dot / np.sqrt(np.maximum(n, 1)))


def train_ftrl(y, n, row, b, counts, scale: float = 5.0, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.5, l2: float = 0.01) -> QualityModel:
    """Follow-the-regularised-leader updates, a document at a time: per-coordinate rates, weights zero within l1."""
    if not len(y):
        return QualityModel(np.zeros(1 << BITS, np.float32), -np.inf, scale)
    z, squares = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_squares = 0.0
    ends = np.searchsorted(row, np.arange(len(y) + 1))
    value = scale * counts / np.sqrt(np.maximum(n, 1))[row]

    def weight(z_, s):
        return np.where(np.abs(z_) <= l1, 0.0, -(z_ - np.sign(z_) * l1) / ((beta + np.sqrt(s)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(y)):
            at, x = b[ends[k] : ends[k + 1]], value[ends[k] : ends[k + 1]]
            w = weight(z[at], squares[at])
            bias = -bias_z / ((beta + np.sqrt(bias_squares)) / alpha)
            error = 1 / (1 + np.exp(-np.clip(w @ x + bias, -500, 500))) - y[k]
            g = error * x
            z[at] += g - (np.sqrt(squares[at] + g * g) - np.sqrt(squares[at])) / alpha * w
            squares[at] += g * g
            bias_z += error - (np.sqrt(bias_squares + error**2) - np.sqrt(bias_squares)) / alpha * bias
            bias_squares += error**2
    return QualityModel(weight(z, squares).astype(np.float32), float(-bias_z / ((beta + np.sqrt(bias_squares)) / alpha)), scale)


def fit_quality(docs: DataFrame, labels: DataFrame, learnable: Column, bound: int = 6000, label: str = "quality") -> QualityModel:
    """Learn from labelled `docs` (doc_id, text) where `learnable`, a condition on doc_id."""
    known = labels_of(labels, label).withColumn("doc_id", F.col("id")).filter(learnable).drop("doc_id")
    known = known.filter(within(F.xxhash64(F.col("id"), F.lit("quality")), known.count(), bound))
    rows = docs.join(known, F.col("doc_id") == F.col("id")).select("text", "y")
    y, n, row, b, counts = unpacked(training_features(rows, word_pairs))
    return train_ftrl(y, n, row, b, counts)


def quality_scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda texts: shared.value(texts))


def op9_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = quality_scores(docs, fit_quality(docs, labels, ~held))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
