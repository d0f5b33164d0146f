"""Text as a process: sentences, n-grams, intentionality, legs, persistent concepts.

Cleaning, words and n-grams of many documents go over arrays (functions.grams); counts that run through all documents in
order of id are prefix sums over ranges of ids (operators.running). The columns below that say the same of one text, by
patterns, are for single sentences and short texts.

Defined results: null texts have no sentence; a null id is an id, before all others; rows that share an id are read as
one document, their n-grams counted together; other columns are left out; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.grams import PlainWords
from tessera.functions.text import CUTOFF, LEG, LEVELS, MIN_BYTES, MIN_COUNT, clean, intentionality, let, ngrams, split_sentences, words
from tessera.operators import running as R
from tessera.runtime import join_null_safe

BLOCK = 1 << 16


def sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern: str = r"[^\n]#", cleaned: bool = False) -> DataFrame:
    """doc_id, n_sentences (with the empty one that stands first), s_idx (from 1), sentence."""
    source = F.col(text) if cleaned else clean(F.col(text))
    dealt = docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).repartition(F.col("doc_id"))
    split = dealt.select("doc_id", split_sentences(source, pattern).alias("list"))
    return split.select("doc_id", (F.size("list") + 1).alias("n_sentences"), F.posexplode_outer("list").alias("pos", "sentence")).filter("sentence is not null").select("doc_id", "n_sentences", (F.col("pos") + 1).alias("s_idx"), "sentence")


def occurrences(sents: DataFrame, levels=LEVELS) -> DataFrame:
    """doc_id, n_sentences, s_idx, n, ngram, pos: every n-gram that is not bound at its ends."""
    made = let(words(F.col("sentence")), lambda w: F.flatten(F.array(*[ngrams(w, n) for n in levels])))
    return sents.select("doc_id", "n_sentences", "s_idx", F.explode_outer(made).alias("g")).filter("g is not null").select("doc_id", "n_sentences", "s_idx", "g.n", "g.ngram", "g.pos")


def running_before(frame: DataFrame, keys: list[str], order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """`frame` with the sum of `value` over the rows of the same keys that come before in order; nulls come first."""
    blocked = frame.withColumn("block", F.coalesce(F.floor(F.col(order) / block), F.lit(-(1 << 62))))
    sums = blocked.groupBy(*keys, "block").agg(F.sum(value).alias("in_block"))
    before = sums.select(*keys, "block", F.coalesce(F.sum("in_block").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_block"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy(*keys, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocked.withColumn("inner", inner).join(before, [*keys, "block"]).withColumn(name, F.col("inner") + F.col("before_block")).drop("block", "inner", "before_block")


def per_document(found: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n, ngram, own (count), first, last (sentences), spread (distinct sentences) of occurrences."""
    return found.groupBy("doc_id", "n", "ngram").agg(
        F.first("n_sentences").alias("n_sentences"), F.count(F.lit(1)).alias("own"), F.min("s_idx").alias("first"), F.max("s_idx").alias("last"), F.count_distinct("s_idx").alias("spread")
    )


def _value(count: np.ndarray, size: np.ndarray, sentences: np.ndarray, leg: int) -> np.ndarray:
    """functions.text.intentionality of n-grams of MIN_BYTES or more, over arrays."""
    rate = count / float(leg)
    with np.errstate(over="ignore"):
        value = rate * size / (1 + np.exp(rate - sentences / float(leg)))
    return np.where(count < MIN_COUNT, 0.0, value)


def _documents(c: R.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk: where each document's occurrences of an n-gram begin, and how many they are."""
    new = np.ones(len(c.entry), bool)
    new[1:] = (c.entry[1:] != c.entry[:-1]) | (c.group[1:] != c.group[:-1])
    at = np.flatnonzero(new)
    return at, np.diff(at, append=len(new))


def topics(docs: DataFrame, leg: int = LEG, cutoff: float = CUTOFF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, ngram, intent: concepts that persist through a document, by the counts so far through all documents."""

    def make(c: R.Chunk, before: np.ndarray) -> pyarrow.Table:
        at, own = _documents(c)
        count = before[c.entry[at]] + at - c.first[c.entry[at]] + own
        new = np.ones(len(c.entry), bool)
        new[1:] = c.sentence[1:] != c.sentence[:-1]
        new[at] = True
        spread = np.add.reduceat(new.astype(np.int64), at) if len(at) else own
        last, sentences = c.sentence[at + own - 1], c.sentences[c.row[at]] + 1
        # The gap, last / own, is over 3 and under 4 legs; the intent is computed once more below, where it is rounded.
        kept = (own == spread) & (last > 3 * own) & (last < 4 * leg * own) & (_value(count, c.bytes[at], sentences, leg) >= cutoff - 1e-9 * abs(cutoff))
        at = at[kept]
        return pyarrow.table({"doc_id": c.ids.take(pyarrow.array(c.row[at])), "n": c.n[at], "ngram": c.text(at), "count": count[kept], "n_sentences": sentences[kept]})

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n int, ngram string, count long, n_sentences long"
    known = R.with_answers(docs, R.counts_before, make, schema, LEVELS, MIN_BYTES, doc_id, text)
    scored = known.withColumn("intent", intentionality(F.col("count"), F.col("ngram"), F.col("n_sentences"), leg))
    return scored.filter(F.col("intent") >= cutoff).select("doc_id", "n", "ngram", F.round("intent", 6).alias("intent"))


def sentence_ranks(docs: DataFrame, leg: int = LEG, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_sentences, s_idx, rank: sums of the intentionality of each sentence's n-grams at the counts so far,
    raised towards both ends of the document. The empty first sentence (s_idx 0) has rank 0."""

    def make(c: R.Chunk, before: np.ndarray) -> pyarrow.Table:
        count = before[c.entry] + np.arange(len(c.entry)) - c.first[c.entry] + 1
        value = _value(count, c.bytes, c.sentences[c.row] + 1, leg)
        # Rows that share an id are one document: a slot for each of its sentences, which each row reads.
        most = np.zeros(int(c.groups[-1]) + 1 if len(c.groups) else 0, np.int64)
        np.maximum.at(most, c.groups, c.sentences)
        base = np.cumsum(most) - most
        score = np.bincount(base[c.group] + c.sentence - 1, value, int(most.sum())) if len(most) else np.zeros(0)
        rows = np.repeat(np.arange(len(c.sentences)), c.sentences)
        s_idx = np.arange(len(rows)) - np.repeat(np.cumsum(c.sentences) - c.sentences, c.sentences) + 1
        own = score[base[c.groups[rows]] + s_idx - 1] if len(rows) else np.zeros(0)
        some = np.flatnonzero(c.sentences)
        heads = some[np.unique(c.groups[some], return_index=True)[1]]
        rows, s_idx, own = np.concatenate([heads, rows]), np.concatenate([np.zeros(len(heads), np.int64), s_idx]), np.concatenate([np.zeros(len(heads)), own])
        return pyarrow.table({"doc_id": c.ids.take(pyarrow.array(rows)), "n_sentences": (c.sentences[rows] + 1).astype(np.int32), "s_idx": s_idx.astype(np.int32), "score": own})

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_sentences int, s_idx int, score double"
    every = R.with_answers(docs, R.counts_before, make, schema, LEVELS, MIN_BYTES, doc_id, text)
    middle = F.floor(F.col("n_sentences") / 2)
    scale = F.when(middle == 0, F.lit(1.0)).otherwise(1 + (middle - F.col("s_idx")) * (middle - F.col("s_idx")) / (middle * middle))
    return every.select("doc_id", "n_sentences", "s_idx", F.round(F.col("score") * scale, 6).alias("rank"))


def ngram_counts(docs: DataFrame, least: int = MIN_COUNT, levels=LEVELS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """n, ngram, count: of n-grams that all documents together have so often; the first chunk that has one gives its words."""

    def make(c: R.Chunk, total: np.ndarray) -> pyarrow.Table:
        kept = np.flatnonzero(total)
        at = c.first[kept]
        return pyarrow.table({"n": c.n[at], "ngram": c.text(at), "count": total[kept]})

    return R.with_answers(docs, R.total_at_first(least), make, "n int, ngram string, count long", levels, 1, doc_id, text)


def own_intents(docs: DataFrame, leg: int = LEG, levels=LEVELS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, ngram, own, intent: of n-grams by their counts within each document, where there is any intent."""

    def make(c: R.Chunk) -> pyarrow.Table:
        at, own = _documents(c)
        kept = own >= MIN_COUNT
        at, own = at[kept], own[kept]
        return pyarrow.table({"doc_id": c.ids.take(pyarrow.array(c.row[at])), "n": c.n[at], "ngram": c.text(at), "own": own, "n_sentences": c.sentences[c.row[at]] + 1})

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n int, ngram string, own long, n_sentences long"
    found = R.alone(docs, make, schema, levels, MIN_BYTES, doc_id, text)
    return found.withColumn("intent", intentionality(F.col("own"), F.col("ngram"), F.col("n_sentences"), leg)).drop("n_sentences")


def legs(ranks: DataFrame, leg: int = LEG) -> DataFrame:
    """doc_id, leg, sentences, average, interest (average by the document's highest). Leg 0 holds leg + 2 sentences, others
    leg + 1; complete legs divide by leg, the last by its own steps."""
    number = F.floor(F.greatest(F.col("s_idx") - 1, F.lit(0)) / (leg + 1)).cast("int")
    sums = ranks.withColumn("leg", number).groupBy("doc_id", "leg").agg(F.count(F.lit(1)).alias("sentences"), F.sum("rank").alias("total"), F.first("n_sentences").alias("n"))
    final = F.floor(F.greatest(F.col("n") - 2, F.lit(0)) / (leg + 1)).cast("int")
    full = F.col("sentences") == F.when(F.col("leg") == 0, leg + 2).otherwise(leg + 1)
    divisor = F.when((F.col("leg") < final) | full, F.lit(leg)).when(F.col("leg") == 0, F.col("sentences")).otherwise(F.col("sentences") + 1)
    averaged = sums.select("doc_id", "leg", "sentences", (F.col("total") / divisor).alias("average"))
    most = F.max("average").over(Window.partitionBy("doc_id"))
    return averaged.withColumn("interest", F.when(most > 0, F.col("average") / most).otherwise(0.0))


def selections(ranks: DataFrame, leg: int = LEG, threshold: float = 0.0, most: int | None = None) -> DataFrame:
    """doc_id, leg, s_idx, rank: the sentences kept of each leg. Of equal ranks the last counts; the number kept is
    0.5 + sqrt(leg * interest), or `most` in legs above a threshold."""
    number = F.floor(F.greatest(F.col("s_idx") - 1, F.lit(0)) / (leg + 1)).cast("int")
    distinct = ranks.withColumn("leg", number).groupBy("doc_id", "leg", "rank").agg(F.max("s_idx").alias("s_idx"))
    joined = join_null_safe(distinct, legs(ranks, leg), ["doc_id", "leg"]).filter(F.col("interest") > threshold)
    keep = F.lit(most) if most else F.floor(0.5 + F.sqrt(leg * F.col("interest")))
    place = F.row_number().over(Window.partitionBy("doc_id", "leg").orderBy(F.desc("rank")))
    return joined.withColumn("place", place).filter(F.col("place") <= keep).select("doc_id", "leg", "s_idx", "rank")


def concept_buckets(found: DataFrame) -> DataFrame:
    """doc_id, n, concepts, total, best: topics by their number of words."""
    return found.groupBy("doc_id", F.size(F.split("ngram", " ")).alias("n")).agg(
        F.count(F.lit(1)).alias("concepts"), F.round(F.sum("intent") + 1e-9, 4).alias("total"), F.max("intent").alias("best")
    )


def static_intent(messages: DataFrame, keys: list[str], text: str = "text", stm: DataFrame | None = None) -> DataFrame:
    """keys, intent: of short texts, by the mean count of their n-grams of each length, times bytes / 7; below 10 bytes 0.

    stm: n, ngram, count; by default the counts of these messages together.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    body = F.regexp_replace(whole, r"[\n\[\]]", "")
    if stm is None:
        return _static_intent(messages.select(F.struct(*keys).alias("doc_id"), F.octet_length(whole).alias("bytes"), F.lower(F.regexp_replace(body, r"[/()]", "")).alias("text")), keys)
    rows = messages.select(*keys, F.octet_length(whole).alias("bytes"), let(words(body), lambda w: F.flatten(F.array(*[ngrams(w, n) for n in LEVELS]))).alias("grams"))
    each = rows.select(*keys, F.explode_outer("grams").alias("g")).filter("g is not null").select(*keys, "g.n", "g.ngram")
    means = each.distinct().join(stm, ["n", "ngram"], "left").groupBy(*keys, "n").agg(F.avg(F.coalesce("count", F.lit(0))).alias("mean"))
    total = means.groupBy(*keys).agg(F.sum("mean").alias("total"))
    value = F.when(F.col("bytes") < 10, 0.0).otherwise(F.coalesce("total", F.lit(0.0)) * F.col("bytes") / 7)
    return join_null_safe(rows.drop("grams"), total, keys, "left").select(*keys, F.round(value, 4).alias("intent"))


def _static_intent(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """static_intent of (doc_id: keys, bytes, text: lower, without what is left out) by the counts of all these texts."""

    def make(c: R.Chunk, count: np.ndarray) -> pyarrow.Table:
        at, _ = _documents(c)
        slot, documents = c.group[at] * 8 + c.n[at], int(c.groups[-1]) + 1 if len(c.groups) else 0
        number = np.bincount(slot, minlength=8 * documents)
        total = np.bincount(slot, count[c.entry[at]], 8 * documents) / np.maximum(number, 1)
        return pyarrow.table({"doc_id": c.ids, "bytes": c.table.column("bytes"), "total": total.reshape(-1, 8).sum(axis=1)[c.groups]})

    kind = bodies.schema["doc_id"].dataType.simpleString()
    found = R.with_answers(bodies, R.counts_in_all, make, f"doc_id {kind}, bytes int, total double", LEVELS, 1, kind=PlainWords, more=("bytes",))
    value = F.when(F.col("bytes") < 10, 0.0).otherwise(F.col("total") * F.col("bytes") / 7)
    return found.select(*[F.col("doc_id")[k].alias(k) for k in keys], F.round(value, 4).alias("intent"))


def overlap(left: DataFrame, right: DataFrame, on=("n", "ngram")) -> DataFrame:
    """What two sets of n-grams share."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), list(on), "left_semi")


def total_text(messages: DataFrame, key: str, order: str, text: str = "text", separator: str = "") -> DataFrame:
    """key, total: the messages of each key in order, as one."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return messages.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["t"]), separator).alias("total"))
