"""Topics from end to end: an article and its edit history to one summary, its rows, and the links of what was said.

Defined results: a subject without an article or without edits has no summary; a ratio with a zero divisor is 0 and the
logarithm of 0 is null; a null text has no sentence; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.functions.grams import SentenceCount
from tessera.functions.text import key_name
from tessera.operators import history, prism
from tessera.operators.graph import make_links, sub_ngrams
from tessera.runtime import join_null_safe, map_arrow, materialize

#: The shortest name that a node may have.
MIN_KEY = 3


def long_enough(key: Column, least: int = MIN_KEY) -> Column:
    """Whether a key has the bytes that a node's name needs."""
    return F.coalesce(F.octet_length(key) >= least, F.lit(False))


def text_sizes(texts: DataFrame) -> DataFrame:
    """subject, bytes, sentences (with the empty one that stands first) of (subject, text)."""
    found = prism.sentences(texts, "subject").groupBy(F.col("doc_id").alias("subject")).agg(F.max("n_sentences").alias("sentences"))
    sized = texts.select("subject", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    return join_null_safe(sized, found, ["subject"], "left").withColumn("sentences", F.coalesce("sentences", F.lit(1)))


def joined_sizes(parts: DataFrame, separator: str = "") -> DataFrame:
    """text_sizes of texts in parts (subject, part: their order, text), with a separator between two: a task holds a piece of one."""
    whole = parts.select("subject", "part", F.coalesce("text", F.lit("")).alias("text"))
    between = (F.count(F.lit(1)) - 1) * len(separator.encode())
    sized = whole.groupBy("subject").agg((F.sum(F.octet_length("text")) + between).cast("long").alias("bytes"))
    dealt = whole.repartition("subject").sortWithinPartitions("subject", "part", "text").select("subject", "text")
    kind = dealt.schema["subject"].dataType

    def run(batches: Iterator) -> Iterator:
        subject, counter = None, None
        names = ["subject", "sentences"]
        for batch in batches:
            done = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if counter is None or key != subject:
                    if counter is not None:
                        done.append((subject, counter.total()))
                    subject, counter = key, SentenceCount()
                    counter.add(text)
                else:
                    counter.add(separator)
                    counter.add(text)
            yield pyarrow.RecordBatch.from_arrays([pyarrow.array([x[0] for x in done], batch.schema.field(0).type), pyarrow.array([x[1] for x in done], pyarrow.int64())], names=names)
            form = batch.schema.field(0).type
        if counter is not None:
            yield pyarrow.RecordBatch.from_arrays([pyarrow.array([subject], form), pyarrow.array([counter.total()], pyarrow.int64())], names=names)

    found = map_arrow(dealt, run, StructType([StructField("subject", kind), StructField("sentences", LongType())]))
    return join_null_safe(sized, found, ["subject"])


def measured(articles: DataFrame, log: DataFrame, separator: str = "", joint: str = "\n") -> DataFrame:
    """subject, bytes, sentences, history_bytes, history_sentences: of articles (subject, text) and the messages of a changelog, in order.

    Articles may come in parts (subject, part, text), which `joint` stands between.
    """
    messages = log.select("subject", F.struct("date", "seq").alias("part"), F.col("message").alias("text"))
    talk = joined_sizes(messages, separator)
    sizes = joined_sizes(articles, joint) if "part" in articles.columns else text_sizes(articles)
    return sizes.join(talk.select("subject", F.col("bytes").alias("history_bytes"), F.col("sentences").alias("history_sentences")), "subject")


def analyze(articles: DataFrame, log: DataFrame, kind: str = "db", separator: str = "", **options) -> DataFrame:
    """The summary of each topic (history.topic_summary), with sentences counted in its article and its history."""
    return history.topic_summary(log, materialize(measured(articles, log, separator), "topic-sizes"), kind, **options)


#: The numbers of a row, in order: length, users of an episode, their pairs, issues, work, selections, mistrust, durations, bots.
ROW = ("L", "LL", "N", "NL", "N2", "N2L", "I", "IL", "W", "WL", "U", "UL", "M", "ML", "TG", "TU", "TGL", "TUL", "TU2", "TU2L", "BF")


def trust_rows(articles: DataFrame, log: DataFrame, separator: str = "", **options) -> DataFrame:
    """subject and the 21 numbers of ROW, of bursts of kind "base"; durations for users are sums over the episodes."""
    sizes = materialize(measured(articles, log, separator), "topic-sizes")
    table = materialize(history.episode_table(log, "base", **options), "topic-episodes")
    pairs = 1 + F.col("users") * (F.col("users") - 1)
    days = F.col("duration_ns").cast("double") / F.lit(float(history.DAY_NS))
    spans = table.groupBy("subject").agg((F.count(F.lit(1)) + 1).alias("opened"), F.sum("users").alias("in_episodes"), F.sum(days).alias("days"), F.sum(days / F.col("users")).alias("TU"), F.sum(days / pairs).alias("TU2"))
    people = log.select("subject", "user").distinct().groupBy("subject").agg(F.count(F.lit(1)).alias("everyone"), F.sum(history.is_bot(F.col("user")).cast("int")).alias("bots"))
    issues = history.undos(log).groupBy("subject").agg(F.sum(F.col("issue").cast("int") + F.col("effective").cast("int")).cast("double").alias("I"))
    c = F.col

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    made = spans.join(people, "subject").join(issues, "subject").join(sizes, "subject").select(
        "subject", c("bytes").cast("double").alias("L"), ratio(c("in_episodes"), c("opened")).alias("N"), "I", ratio(c("history_bytes"), c("bytes")).alias("W"), ratio(c("history_sentences"), c("sentences")).alias("U"),
        ratio(c("history_sentences"), c("history_bytes")).alias("M"), ratio(c("days"), c("opened")).alias("TG"), "TU", "TU2", ratio(c("bots"), c("everyone") - c("bots")).alias("BF"),
    )
    made = made.withColumn("N2", c("N") * c("N") - c("N"))
    logs = {f"{x}L": F.ln(c(x)) for x in ("L", "N", "N2", "I", "W", "U", "M")} | {f"{x}L": F.ln(1 + c(x)) for x in ("TG", "TU", "TU2")}
    return made.withColumns(logs).select("subject", *ROW)


def _words(phrase: str) -> Column:
    return F.size(F.split(phrase, " "))


def _ngram(phrase: str) -> Column:
    return F.concat(F.lit("ngram"), _words(phrase).cast("string"), F.lit("/"), F.col(phrase))


def story_links(selected: DataFrame) -> DataFrame:
    """Links of selected sentences (doc_id, s_idx): topic LEADS_TO its first event, each event LEADS_TO the next."""
    w = Window.partitionBy("doc_id").orderBy("s_idx")
    subject = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = selected.select("doc_id", "s_idx").distinct().withColumn("place", F.row_number().over(w))

    def event(place: Column) -> Column:
        return F.concat(F.lit("event/"), key_name(F.concat(subject, F.lit("_story")), place))

    before = F.when(F.col("place") == 1, F.concat(F.lit("topic/"), subject)).otherwise(event(F.col("place") - 1))
    return make_links(placed, before, F.lit("LEADS_TO"), event(F.col("place")), F.lit(0.0), keyed=False)


def difference_links(concepts: DataFrame, least: int = 3) -> DataFrame:
    """Links of what edits say (episode, ngram): an episode CONTAINS the concepts of `least` words or more, and they their parts."""
    kept = concepts.filter((_words("ngram") >= least) & long_enough(key_name(F.col("ngram")))).select("episode", "ngram").distinct()
    outer = make_links(kept, F.concat(F.lit("episode/"), F.col("episode").cast("string")), F.lit("CONTAINS"), _ngram("ngram"), F.lit(1.0), keyed=False)
    parts = sub_ngrams(kept.select("ngram").distinct()).filter(long_enough(key_name(F.col("part"))))
    return outer.union(make_links(parts, _ngram("phrase"), F.lit("CONTAINS"), _ngram("part"), F.lit(1.0), keyed=False))
