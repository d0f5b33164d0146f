"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are runs of 2 to 4 bytes within words, with a mark for a word's edge. The vector of a text is the mean
of its subwords' embeddings; embeddings and softmax are trained together by stochastic gradient descent in
numpy on a bounded sample of labelled rows (`bound`). A fifth of the sample is kept out of training: on it a
temperature is fitted, so that scores are calibrated, and the score is chosen below which a prediction is
rejected (`accepted` is false): the lowest at which those accepted are right to a share of `precision`.

For scoring, embeddings and softmax are multiplied to one table. Texts are read whole, in parts of bounded size.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text if no row has a
language; rows without an id are scored, but not learned from; equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import hashing
from tessera.llm.classifiers import within
from tessera.llm.token_files import slices
from tessera.runtime import map_arrow, table

BITS = 16
SIZES = (2, 3, 4)
#: Letters in lower case; any other byte becomes the mark of a word's edge. Digits tell nothing of a language.
EDGE = np.where(hashing.LETTERS, hashing.LOWER, 32).astype(np.uint8)
EDGE[48:58] = 32


def subwords(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start of each text in the run, text numbers, buckets) by part: buckets in order of text."""
    content, at = hashing.text_bytes(texts)
    for start, stop in hashing.parts(content, at):
        low = EDGE[content[start:stop]].astype(np.uint32)
        low = np.concatenate([[np.uint32(32)], low, [np.uint32(32)]])
        letter = low != 32
        first = np.searchsorted(at, start, "right") - 1
        for n in SIZES:
            if len(low) < n:
                continue
            size = len(low) - n + 1
            value = low[:size].copy()
            inner = np.ones(size, bool)
            for k in range(1, n):
                value = (value << np.uint32(8)) | low[k : k + size]
                if k < n - 1:
                    inner &= letter[k : k + size]
            if n == 2:
                inner = letter[:size] & letter[1:]
            spots = np.flatnonzero(inner)
            hashed = ((value[spots] * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) ^ (value[spots] >> np.uint32(15))) * np.uint32(2246822519)
            # The byte after the edge belongs to the subword's text.
            text = np.searchsorted(at, start + np.maximum(spots - 1, 0) + (1 if n > 2 else 0), "right") - 1
            yield np.clip(text, first, len(at) - 2), (hashed >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # of each bucket for each language
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for text, b in subwords(texts):
            if len(text):
                cuts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                np.add.at(total, text[cuts], np.add.reduceat(self.weights[b], cuts, axis=0))
                n += np.bincount(text, minlength=len(texts))
        return total / np.maximum(n, 1)[:, None] + self.bias

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The language's number and its score."""
        if not self.languages:
            return np.full(len(texts), -1), np.zeros(len(texts))
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(texts)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], dim: int = 16, epochs: int = 5, rate: float = 1.0, precision: float = 0.99) -> LanguageModel:
    """rows: (buckets, shares) of each text; every fifth row calibrates."""
    k = len(languages)
    if not k:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    random = np.random.default_rng(11)
    embed, head, bias = random.normal(0, dim**-0.5, (1 << BITS, dim)), np.zeros((dim, k)), np.zeros(k)
    kept = np.arange(len(rows)) % 5 == 4
    learn, steps, done = np.flatnonzero(~kept), epochs * int((~kept).sum()), 0
    for _ in range(epochs):
        for i in random.permutation(learn):
            b, x = rows[i]
            if not len(b):
                continue
            vector = x @ embed[b]
            error = softmax(vector @ head + bias)
            error[y[i]] -= 1
            now = rate * (1 - done / steps)
            # A text's embeddings share its step, each by its share; scaled so that the whole text moves by about the rate.
            embed[b] -= now * (x / (x @ x) * 0.1)[:, None] * (head @ error)[None, :]
            head -= now * np.outer(vector, error)
            bias -= now * 0.1 * error
            done += 1
    weights = (embed @ head).astype(np.float32)
    model = LanguageModel(languages, weights, bias, 1.0, 0.0)
    check = [i for i in np.flatnonzero(kept) if len(rows[i][0])]
    if check:
        z, truth = np.array([rows[i][1] @ weights[rows[i][0]] + bias for i in check]), y[check]
        grid = np.exp(np.linspace(np.log(0.2), np.log(10), 60))
        loss = [-np.log(softmax(z / t)[np.arange(len(check)), truth] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        order = np.argsort(-p.max(axis=1), kind="stable")
        right = np.cumsum((p.argmax(axis=1) == truth)[order]) / np.arange(1, len(check) + 1)
        good = np.flatnonzero(right >= precision)
        model.threshold = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, learnable: Column, bound: int = 6000, lang: str = "lang", **options) -> LanguageModel:
    """Learn from `docs` (doc_id, text, lang) where `learnable`, a condition on doc_id."""
    pool = docs.filter(learnable & F.col("doc_id").isNotNull() & F.col(lang).isNotNull() & F.col("text").isNotNull())
    size = pool.select("doc_id").count()
    rows = pool.filter(within(F.xxhash64(F.col("doc_id"), F.lit("language")), size, bound)).select("text", F.col(lang).alias("lang"))

    def pack(batches):
        for batch in (part for whole in batches for part in slices(whole, 0)):
            found = [(t << BITS) | b for t, b in subwords(batch.column(0))]
            keys, counts = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
            ends = np.searchsorted(keys >> BITS, np.arange(batch.num_rows + 1))
            packed = [((keys[i:j] & 0xFFFF).astype("<u2").tobytes(), counts[i:j].astype("<u4").tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([batch.column(1), pa.array([b for b, _ in packed], pa.binary()), pa.array([c for _, c in packed], pa.binary())], ["lang", "buckets", "counts"])

    found = map_arrow(rows, pack, "lang string, buckets binary, counts binary").toArrow().to_pydict()
    names = sorted(set(found["lang"]))
    y = np.array([names.index(x) for x in found["lang"]], int)
    shares = []
    for b, c in zip(found["buckets"], found["counts"], strict=True):
        c = np.frombuffer(c, "<u4").astype(float)
        shares.append((np.frombuffer(b, "<u2").astype(np.int64), c / max(c.sum(), 1)))
    return train(shares, y, names, **options)


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        names = np.array([*own.languages, "und"], object)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            best, score = own(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.where(letters, best, -1), np.where(letters, score, 0.0)
            yield pa.record_batch(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(letters & (score >= own.threshold) & (best >= 0))], ["doc_id", "lang_pred", "score", "accepted"]
            )

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), letters.alias("letters")), run, "doc_id long, lang_pred string, score double, accepted boolean")


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = predict(docs, fit(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
