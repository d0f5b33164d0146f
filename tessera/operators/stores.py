"""Keyed stores as tables: n-grams, episode rows, overlays, bulk lookups, and text whose every character is a token.

A store is the last version of each key, found by one aggregate that combines before the shuffle. Defined results: a
null key is a key of its own; of versions with one sequence number any may be last; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import LEVELS, key_name
from tessera.operators.components import connected_components


def save_ngrams(counts: DataFrame, seq: str = "seq") -> DataFrame:
    """n, key (canonical name), raw, value: of (n, raw, value, seq); of n-grams with one canonical name the last stays."""
    keyed = counts.withColumn("key", key_name(F.col("raw")))
    return keyed.groupBy("n", "key").agg(F.max_by(F.struct("raw", "value"), seq).alias("last")).select("n", "key", "last.raw", "last.value")


def load_ngrams(store: DataFrame, limit: int = 15_000, levels=LEVELS) -> DataFrame:
    """n, key, value: at most `limit` of each length, by key (the limit of a working memory, not of the store)."""
    each = [store.filter(F.col("n") == n).orderBy("key").limit(limit).select("n", "key", "value") for n in levels]
    return reduce(DataFrame.unionByName, each)


def save_rows(versions: DataFrame, key: str, fields: list[str], seq: str = "seq") -> DataFrame:
    """key, fields, changes: the last row of each key, and how often a version differed from the one before it."""
    before = F.lag(F.struct(*fields)).over(Window.partitionBy(key).orderBy(seq))
    marked = versions.withColumn("changed", (~before.eqNullSafe(F.struct(*fields)) & before.isNotNull()).cast("long"))
    kept = marked.groupBy(key).agg(F.max_by(F.struct(*fields), seq).alias("last"), F.sum("changed").alias("changes"))
    return kept.select(key, *[F.col(f"last.{c}").alias(c) for c in fields], "changes")


def lookup(keys: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """`keys` with the store's row of each key, and found; keys that it does not have stay. A store has a key once."""
    return keys.join(store.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def overlay(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of either table; where both have a key, the other's."""
    top = other.select(F.col(key).alias("top_key"), F.col(value).alias("top_value"), F.lit(True).alias("top"))
    joined = base.join(top, base[key].eqNullSafe(top["top_key"]), "full")
    return joined.select(F.when(F.col("top"), F.col("top_key")).otherwise(base[key]).alias(key), F.when(F.col("top"), F.col("top_value")).otherwise(base[value]).alias(value))


def has_link_type(types: Column, wanted: str) -> Column:
    """Whether a list of link types holds one."""
    return F.coalesce(F.exists(types, lambda t: t == wanted), F.lit(False))


def burst_unions(bursts: DataFrame, burst: list[str], user: str = "user") -> DataFrame:
    """node, component: users that worked together in a burst, however indirectly. Each is tied to the burst's first."""
    first = bursts.groupBy(*burst).agg(F.min(user).alias("first"))
    same = reduce(lambda a, b: a & b, [bursts[c].eqNullSafe(first[c]) for c in burst])
    return connected_components(bursts.join(first, same).select(F.col(user).alias("a"), F.col("first").alias("b")))


def cluster_histogram(labels: DataFrame) -> DataFrame:
    """size, clusters: how many components have how many nodes."""
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


#: What ends a sentence, and what parts its fragments, in text without spaces.
STOP, PARTS = "。", "[。，（）《》—]"


def rune_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, s_idx (from 1), sentence: up to each full stop; what follows the last is left out."""
    pieces = F.split(F.coalesce(F.col(text), F.lit("")), STOP)
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(whole).alias("at", "sentence")).select("doc_id", (F.col("at") + 1).alias("s_idx"), "sentence")


def rune_tokens(sentences: DataFrame) -> DataFrame:
    """doc_id, s_idx, rune: every character of a fragment is a token."""
    runes = F.filter(F.split(F.regexp_replace("sentence", PARTS, ""), ""), lambda c: c != "")
    return sentences.select("doc_id", "s_idx", F.explode(runes).alias("rune"))


def rune_work(tokens: DataFrame, strokes: DataFrame) -> DataFrame:
    """doc_id, s_idx, tokens, work: half of the strokes (rune, strokes) of a sentence; unknown runes take none."""
    joined = tokens.join(F.broadcast(strokes), "rune", "left")  # a table of characters: some ten thousand rows
    return joined.groupBy("doc_id", "s_idx").agg(F.count(F.lit(1)).alias("tokens"), (F.sum(F.coalesce("strokes", F.lit(0))) / 2).alias("work"))
