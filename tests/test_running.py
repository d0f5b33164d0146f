"""Sentences and n-grams over arrays against the patterns and plain counts."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.grams import Words, slices
from tessera.functions.text import intentionality
from tessera.operators import prism, running

ODD = ["a", "b", "the", "in", "It's", "word", "Åø", "æ-b", " ", " ", " ", "\n", "\n", "\n", ".", ",", ":", ";", "!", "?", "(", ")", "<", ">", "<b>", "\\x", "\\", "–", "ä", "é", "#", "=", "/", "漢", "\U0001f600", "\U0010fffe", "℀", "1", "\t", "“"]


def _odd(seed: int, n: int) -> list[str | None]:
    r = random.Random(seed)
    return [None, "", *["".join(r.choice(ODD) for _ in range(r.randrange(60))) for _ in range(n)]]


def test_words_like_the_patterns(spark):
    docs = spark.createDataFrame(list(enumerate(_odd(1, 4000))), "doc_id long, text string")
    sents = prism.sentences(docs)
    expected = Counter((r.doc_id, r.s_idx, r.n, r.ngram, r.pos) for r in prism.occurrences(sents).collect())
    size = {r.doc_id: r.n_sentences - 1 for r in sents.select("doc_id", "n_sentences").distinct().collect()}
    words = Words([r.text for r in docs.orderBy("doc_id").collect()])
    assert [size.get(i, 0) for i in range(4002)] == words.sentences.tolist()
    letters, start = words.letters()
    found = Counter()
    for n, last, _, _, wide in words.grams((1, 2, 3, 4, 5, 6), 1):
        for k, g in zip(last.tolist(), slices(letters, start[last - n + 1], wide).to_pylist(), strict=True):
            found[(int(words.doc[k]), int(words.sentence[k]), n, g, int(words.place[k]))] += 1
    assert found == expected


def test_packed():
    for x in ([], [0], [5, -(1 << 63), (1 << 63) - 1], list(range(1000))):
        assert running.unpack(running.pack(np.array(x, np.int64))).tolist() == x


def test_counts_over_chunks(spark, monkeypatch):
    """Chunks of few bytes, ids that repeat or are null: the running counts are those of one pass in order."""
    monkeypatch.setattr(running, "CHUNK", 1 << 10)
    monkeypatch.setattr(running, "PIECE", 1 << 8)
    monkeypatch.setattr(running, "BUCKET", 1 << 9)
    r = random.Random(3)
    texts = [(None if i == 7 else i // 2 if i < 40 else i, " ".join(r.choice(["alpha", "gamma", "delta", "omega.", "sigma!"]) for _ in range(r.randrange(30)))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert running.chunks(docs)[0].select("chunk").distinct().count() > 3
    occ = prism.occurrences(prism.sentences(docs)).filter(F.octet_length("ngram") >= 5).collect()
    every = Counter((x.n, x.ngram) for x in occ)
    assert {(x.n, x.ngram): x["count"] for x in prism.ngram_counts(docs).collect()} == {k: c for k, c in every.items() if c >= 3}
    own = Counter((x.doc_id, x.n, x.ngram) for x in occ)
    assert {(x.doc_id, x.n, x.ngram): x.own for x in prism.own_intents(docs).collect()} == {k: c for k, c in own.items() if c >= 3}
    before, scored = Counter(), []
    by = {}
    for x in occ:
        by.setdefault((x.doc_id, x.n, x.ngram), []).append(x)
    for key in sorted(by, key=lambda k: (k[0] is not None, k[0] or 0)):
        rows = by[key]
        s = [x.s_idx for x in rows]
        before[key[1:]] += len(rows)
        if key[0] is not None and key[0] >= 20 and len(set(s)) == len(s) and max(s) / len(s) > 3:
            scored.append((*key, before[key[1:]], rows[0].n_sentences))
    made = spark.createDataFrame(scored, "doc_id long, n int, ngram string, c long, s int").withColumn("intent", F.round(intentionality(F.col("c"), F.col("ngram"), F.col("s"), 10), 6)).filter("intent >= 0.3")
    found = prism.topics(docs, 10).filter("doc_id >= 20")
    assert made.count() > 10
    assert {tuple(x) for x in found.collect()} == {tuple(x) for x in made.select("doc_id", "n", "ngram", "intent").collect()}


def test_shared(spark):
    left = spark.createDataFrame([(1, "one two three four. five six"), (2, "one two three")], "doc_id long, text string")
    right = spark.createDataFrame([("x", "zero one two three"), ("y", None)], "doc_id string, text string")
    assert {(r.n, r.shared) for r in running.shared(left, right, (1, 2, 3)).collect()} == {(1, 3), (2, 2), (3, 1)}


def test_static_intent_in_chunks(spark, monkeypatch):
    """By the counts of all messages, as with a table of them; keys may repeat or be null, words may be of any letters."""
    monkeypatch.setattr(running, "CHUNK", 1 << 9)
    r = random.Random(5)
    parts = [*ODD, "Ünï", "[x]", "it's", "漢字", " ", " ", " ", "of", "alpha", "\U0010ffff"]
    rows = [(None if i == 3 else i % 50, None if i == 4 else i % 7, "".join(r.choice(parts) for _ in range(r.randrange(40)))) for i in range(200)]
    frame = spark.createDataFrame([*rows, (1, 1, None)], "a long, b int, text string")
    stm = frame.select(F.explode_outer(prism.let(prism.words(F.regexp_replace("text", r"[\n\[\]]", "")), lambda w: F.flatten(F.array(*[prism.ngrams(w, n) for n in prism.LEVELS])))).alias("g")).filter("g is not null").groupBy("g.n", "g.ngram").agg(F.count(F.lit(1)).alias("count"))
    plain = lambda f: Counter((x.a, x.b, round(x.intent, 3)) for x in f.collect())
    assert plain(prism.static_intent(frame, ["a", "b"])) == plain(prism.static_intent(frame, ["a", "b"], stm=stm))
