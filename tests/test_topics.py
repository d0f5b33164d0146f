"""Small cases of whole topics."""

import random

from pyspark.sql import functions as F

from tessera.functions import grams
from tessera.operators import topics as O
from tests.test_edges import _log
from tests.test_running import ODD


def test_measured(spark):
    log = _log(spark, [(1, "a", 5, 0), (2, "b", 5, 0)]).withColumn("subject", F.explode(F.array(F.lit(0), F.lit(1))))
    articles = spark.createDataFrame([(0, "One. Two. Three."), (1, None), (2, "no edits")], "subject int, text string")
    found = {r.subject: r for r in O.measured(articles, log, ". ").collect()}
    assert set(found) == {0, 1}
    assert (found[0].bytes, found[0].sentences, found[1].bytes, found[1].sentences) == (16, 4, 0, 1)
    assert found[0].history_bytes == 4 and found[0].history_sentences == found[1].history_sentences
    rows = {r.subject: r for r in O.trust_rows(articles, log, ". ").collect()}
    assert rows[0].L == 16 and rows[1].L == 0 and rows[1].LL is None and rows[1].W == 0 and list(rows[0].asDict()) == ["subject", *O.ROW]
    assert O.trust_rows(articles, log.filter("subject > 9")).count() == O.analyze(articles.filter("subject > 9"), log).count() == 0


def test_links(spark):
    picked = spark.createDataFrame([(7, 5), (7, 2), (7, 9), (None, 1), (7, 5)], "doc_id long, s_idx int")
    found = {(r.from_id, r.to_id) for r in O.story_links(picked).collect()}
    assert found == {("topic/7", "event/7-story_1"), ("event/7-story_1", "event/7-story_2"), ("event/7-story_2", "event/7-story_3"), ("topic/", "event/-story_1")}
    concepts = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (1, "too short"), (2, None), (2, "a b c d")], "episode int, ngram string")
    links = {(r.from_id, r.to_id) for r in O.difference_links(concepts).collect()}
    assert ("episode/1", "ngram3/one_two_three") in links and ("ngram3/one_two_three", "ngram1/two") in links and ("episode/2", "ngram4/a_b_c_d") in links
    assert not any("too" in a or "too" in b for a, b in links) and ("ngram4/a_b_c_d", "ngram1/a") not in links
    assert O.difference_links(concepts.filter("episode > 9")).count() == O.story_links(picked.filter("s_idx > 99")).count() == 0


def test_sizes_of_parts(spark, monkeypatch):
    """Texts in parts, cut anywhere, are counted as if they were one, tags that end in a later part or never too."""
    monkeypatch.setattr(grams, "PIECE", 24)
    r = random.Random(11)
    parts = [*ODD, "x y", "Yes. No", "word ", "word "]
    texts = {s: [r.choice([None, "".join(r.choice(parts) for _ in range(r.randrange(30)))]) for _ in range(r.randrange(1, 9))] for s in range(600)}
    texts |= {None: ["a <b", "c. d! ", "e> f. g"], 1000: ["a <b. c", "d. e", ""]}
    for separator in ("", "\n", ". "):
        expected = {s: grams.Words([separator.join(t or "" for t in ts)]).sentences[0] + 1 for s, ts in texts.items()}
        found = {}
        for s, ts in texts.items():
            count = grams.SentenceCount()
            for k, t in enumerate(ts):
                count.add((separator if k else "") + (t or ""))
            found[s] = count.total()
        assert found == expected
    frame = spark.createDataFrame([(s, k, t) for s, ts in texts.items() for k, t in enumerate(ts)], "subject int, part int, text string")
    sizes = {r.subject: (r.bytes, r.sentences) for r in O.joined_sizes(frame, ". ").collect()}
    assert sizes == {s: (len(". ".join(t or "" for t in ts).encode()), expected[s]) for s, ts in texts.items()}
