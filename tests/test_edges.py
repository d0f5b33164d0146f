"""Small cases: empty and odd inputs, boundaries, worked examples."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import context as C
from tessera.functions import text as T
from tessera.functions.times import torus_slot, week_slots
from tessera.operators import graph as G
from tessera.operators import history as H
from tessera.operators import prism
from tessera.operators.components import connected_components, joined_components
from tessera.operators.promises import learned, outcomes, rate_limited, trust
from tessera.sources import html, texts

SYMBOLS = {c: (i + 1) / 10 for i, c in enumerate("abcdefg")}


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("test & ( a | b)", 0), ("(test2 & ( a | b))|(e.f.g)", 0.21), ("(test3 & ( c | d))", 0), ("(test3b) & (( c | d))", 0), ("!d", 0), ("nosuchsymbol", 0),
        ("!nosuchsymbol", 1), ("!(nosuchsymbol)", 1), ("!(nosuchsymbol|d)", 0), ("!(nosuchsymbol|!d)", 1), ("a|b.c", 0.16), ("a||b", 0.3), ("a&&b", 0.02),
    ],
)
def test_expressions(spark, expression, value):
    column = C.compile_expression(expression, lambda n: F.lit(SYMBOLS.get(n)).cast("double"))
    assert spark.range(1).select(column.alias("v")).first().v == pytest.approx(value)


def test_bad_expression(spark):
    for bad in ("(test3a) (& ( c | d))", "", "a &", "(a", "a b"):
        with pytest.raises(ValueError):
            C.parse(bad)
    assert spark.range(1).select(C.compile_expression("(a) (& b)", F.lit, compat=True).alias("v")).first().v == -1


def test_empty_and_odd_texts(spark):
    docs = spark.createDataFrame([(0, ""), (1, None), (2, "?!...,;"), (3, "One."), (4, "Why? no. Well! yes"), (5, "word " * 3)], "doc_id long, text string")
    found = {r.doc_id: r.n for r in prism.sentences(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {2: 2, 3: 1, 4: 4, 5: 1}
    assert prism.topics(docs, 10).count() == 0
    ranks = prism.sentence_ranks(docs, 10)
    assert all(not math.isnan(r["rank"]) for r in ranks.collect())
    empty = docs.filter("doc_id > 99")
    assert prism.topics(empty).count() == prism.legs(prism.sentence_ranks(empty)).count() == 0


@pytest.mark.parametrize("sentences", [10, 11, 12, 13, 22, 23, 24])
def test_legs_like_the_loop(spark, sentences):
    """Against the loop: a leg is closed after more than W steps."""
    w, ranks = 10, [float(i % 7 + 1) for i in range(sentences)]
    expected, steps, total = [], 0, 0.0
    for r in ranks:
        total += r
        if steps > w:
            expected.append(total / w)
            steps, total = 0, 0.0
        steps += 1
    if total:
        expected.append(total / steps)
    frame = spark.createDataFrame([(0, sentences, i, r) for i, r in enumerate(ranks)], "doc_id long, n_sentences int, s_idx int, rank double")
    found = [r.average for r in prism.legs(frame, w).orderBy("leg").collect()]
    assert found == pytest.approx(expected)


def test_running_count_over_blocks(spark):
    frame = spark.createDataFrame([(i, "x" if i % 3 else "y", i % 4 + 1) for i in range(200)], "d long, k string, v long")
    found = {r.d: r.before for r in prism.running_before(frame, ["k"], "d", "v", "before", block=16).collect()}
    totals = {"x": 0, "y": 0}
    for i in range(200):
        k = "x" if i % 3 else "y"
        assert found[i] == totals[k]
        totals[k] += i % 4 + 1


def test_key_names(spark):
    rows = spark.createDataFrame([("Hello, World!",), ("a\tb" + "c" * 60,), ("",), (None,)], "s string")
    assert [r.k for r in rows.select(T.key_name(F.col("s")).alias("k")).collect()] == ["hello--world-", "axb" + "c" * 37, "", None]


def test_fnv_vector(spark):
    row = spark.createDataFrame([("topic/Laser", "THEN", "episode/Laser_ep_1")], "a string, s string, b string")
    assert row.select(G.link_key(F.col("a"), F.col("s"), F.col("b")).alias("k")).first().k == "key_253897766132885936"


def test_unknown_names_stop(spark):
    row = spark.createDataFrame([("a", "b")], "a string, b string")
    with pytest.raises(Exception, match="unknown association"):
        G.make_links(row, F.col("a"), F.lit("NOPE"), F.col("b"), F.lit(1.0), keyed=False).collect()
    with pytest.raises(Exception, match="unknown kind"):
        G.make_nodes(row, F.lit("planet"), F.col("a"), F.col("b")).collect()


def test_upserts(spark):
    v = spark.createDataFrame([("a", "THEN", "b", 2.0, False, 1), ("a", "THEN", "b", -5.0, True, 2), ("c", "THEN", "d", -1.0, False, 1)], "from_id string, semantics string, to_id string, weight double, negation boolean, seq long")
    assert {r.from_id: r.weight for r in G.upsert_links(v).collect()} == {"a": 2.0, "c": -1.0}
    n = spark.createDataFrame([("x", "one", 1.0, 1), ("x", "", 0.0, 2), ("y", "", 0.0, 1)], "id string, data string, weight double, seq long")
    assert {r.id: r.data for r in G.upsert_nodes(n).collect()} == {"x": "one", "y": ""}


def test_chains_and_cycles(spark):
    links = spark.createDataFrame([("t", "n0", "THEN"), *[(f"n{i}", f"n{i + 1}", "THEN") for i in range(250)], ("u", "c0", "THEN"), ("c0", "c1", "THEN"), ("c1", "c0", "THEN")], "from_id string, to_id string, semantics string").withColumn("link_type", F.lit("Follows"))
    found = G.chain_from(links, "THEN", "Follows", hops=200).filter("start in ('t', 'u')").groupBy("start").count().collect()
    assert {r.start: r["count"] for r in found} == {"t": 200, "u": 2}
    paths = G.paths_from(links.filter("from_id like 'c%' or from_id = 'u'"), spark.createDataFrame([("u",)], "node string"), 5).collect()
    assert [r.path for r in paths] == [["u", "c0", "c1"]]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (None, 4), *[(100 + i, 101 + i) for i in range(40)], *[(1000, 2000 + i) for i in range(300)]]
    frame = spark.createDataFrame(edges, "a long, b long")
    labels = connected_components(frame)
    found = {r.node: r.component for r in labels.collect()}
    assert len(found) == labels.count() == 3 + 2 + 41 + 301
    assert found[3] == 1 and found[11] == 10 and found[140] == 100 and found[2299] == 1000
    more = {r.node: r.component for r in joined_components(labels, spark.createDataFrame([(3, 140), (7, 8), (11, 7)], "a long, b long")).collect()}
    assert more[140] == 1 and more[8] == 7 and more[10] == 7 and more[2000] == 1000 and len(more) == 349
    assert connected_components(frame.filter("a > 9999")).count() == 0


def _log(spark, rows):
    return spark.createDataFrame([(0, i, t, u, d, "m", r) for i, (t, u, d, r) in enumerate(rows)], "subject int, seq int, t long, user string, edit_delta long, message string, revert int").withColumn("date", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")


def _boundaries(rows, kind, scale=10.0, days=1.0):
    day, last, ema, burst, out = int(days * H.DAY_NS), 0, 0.0 if kind == "ml" else 6e10, rows[0][0] * 10**9, []
    for i, (t, *_) in enumerate(rows):
        t *= 10**9
        gap, length = t - last, t - burst
        after = 0.4 * ema + 0.6 * gap
        closes = {"base": gap > scale * ema and length > day, "db": gap > day and length > day and gap > scale * ema, "ml": length > 2 * day and gap > after and gap > 10 * day}[kind]
        closes = closes or i == len(rows) - 1
        if closes:
            burst = t if kind == "base" else rows[min(i + 1, len(rows) - 1)][0] * 10**9
        out.append(closes)
        ema, last = after, t
    return out


@pytest.mark.parametrize("kind", ["base", "db", "ml"])
def test_episodes_like_the_loop(spark, kind):
    times, t = [], 1_700_000_000
    for i in range(120):
        t += 90000 * (13 if i % 29 == 28 else 1) if i % 10 > 7 else 60
        times.append((t, "ab"[i % 2], 10, 0))
    found = H.episodes(_log(spark, times), kind).orderBy("seq").collect()
    assert [r.closes for r in found] == _boundaries(times, kind)
    one = H.episodes(_log(spark, times[:1]), kind).collect()
    assert [(r.episode, r.closes) for r in one] == [(1, True)]


def test_undos(spark):
    rows = [(1, "a", 100, 1), (2, "b", -95, 1), (3, "a", 50, 1), (4, "a", -50, 1), (4, "b", 0, 0)]
    found = H.undos(_log(spark, rows)).orderBy("seq").collect()
    assert [r.explicit for r in found] == [False, False, True, True, False]
    assert [r.issue for r in found] == [False, False, True, False, False]
    assert [r.effective for r in found] == [False, True, False, True, False]


def test_promises(spark):
    rows = spark.createDataFrame([("p", 1, 10, 5.0), ("p", 2, 10, 5.0), ("p", 3, 40, 5.0), ("q", 1, 0, 1.0)], "promise string, seq long, t long, q double")
    found = {(r.promise, r.i): r for r in learned(rows).collect()}
    assert (found["p", 1].q, found["p", 1].q_av, found["p", 2].q_av, found["p", 3].q_av, found["p", 3].q_var, found["p", 3].dt_av) == (0.0, 3.0, 2.5, 5.0, 0.0, 15.0)
    kept = outcomes(learned(rows), 10.0, 100.0)
    assert kept.filter("delta < 0 or isnan(delta)").count() == 0
    zero = trust(spark.createDataFrame([("z", 1, 0.0), ("z", 2, 0.5)], "promise string, i int, delta double")).first()
    assert zero.reliability == pytest.approx(0.4 * 0.2 + 0.3)


def test_rate_limit(spark):
    s = 10**9
    rows = spark.createDataFrame([("n", 1, 0, s), ("n", 2, 20 * s, 21 * s), ("n", 3, 31 * s, 32 * s), ("n", 4, 61 * s, 62 * s)], "name string, seq long, begin_ns long, end_ns long")
    assert {r.seq: r.ready for r in rate_limited(rows).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_week(spark):
    slots = week_slots(spark).orderBy("idx").collect()
    assert len({r.slot for r in slots}) == 2016 and slots[0].slot == "Sun:Hr23:Min50_55"
    late = spark.sql("SELECT TIMESTAMP '2024-01-07 23:57:00' AS t").select(torus_slot(F.col("t")).alias("s")).first()
    assert late.s == "Sun:Hr23:Min55_00"


def test_html(spark):
    page = "<html><body><h1>x</h1><p>One. Two<script>no</script><b>three?</p></body></html>"
    rows = spark.createDataFrame([(0, page), (1, "<p>never ends"), (2, None)], "page_id long, html string")
    assert {r.page_id: r.text for r in html.page_text(rows).collect()} == {0: "One.# Two three?#", 1: "", 2: ""}
    diff = '<body><td class="diff-context diff-side-added">kept words</td><ins>new</ins><del>old</del></body>'
    found = html.diff_text(spark.createDataFrame([(0, diff)], "page_id long, html string")).first()
    assert (found.context, found.added, found.removed) == ("kept words", "new", "old")


def test_text_sources(spark, tmp_path):
    (tmp_path / "s.txt").write_text("Alpha_Beta\nGamma–Delta\n\n")
    assert [r.subject for r in texts.subjects(spark, str(tmp_path / "s.txt")).collect()] == ["Alpha_Beta", "Gamma-Delta"]
    (tmp_path / "k.txt").write_text("一 100 1\n二 50 2\nbad\n三 7 0\n")
    strokes = texts.strokes(spark, str(tmp_path / "k.txt"))
    assert strokes.count() == 2
    assert texts.stroke_work(spark.createDataFrame([("一二",)], "text string"), strokes).first().work == 1.5
    (tmp_path / "d.txt").write_text("A <b>text</b>. More; text\n")
    assert texts.narratives(spark, str(tmp_path / "d.txt")).first().text.startswith("A text.# More.# text")
    assert texts.characters(spark, str(tmp_path / "k.txt")).filter("ch = '一'").count() == 1
    texts.append_values(spark.range(2), str(tmp_path / "out"), "id")
    assert texts.first_lines(spark, str(tmp_path / "out")).count() == 2


def test_null_keys(spark):
    """A null subject, name or id is one of its own, and fares as any other."""
    s = 10**9
    rows = [(n, i, t * s, None if i == 2 else (t + 1) * s) for n in ("a", None) for i, t in enumerate((0, 20, 31, 40, 200))]
    found = rate_limited(spark.createDataFrame(rows, "name string, seq long, begin_ns long, end_ns long")).collect()
    for name in ("a", None):
        assert {r.seq: (r.ready, r.expired) for r in found if r.name == name} == {0: (True, False), 1: (False, False), 2: (True, False), 3: (True, False), 4: (True, False)}
    lone = spark.createDataFrame([("n", 0, 0, None), ("n", 1, 50 * s, None), ("n", 2, 200 * s, None)], "name string, seq long, begin_ns long, end_ns long")
    assert [(r.ready, r.expired) for r in rate_limited(lone).orderBy("seq").collect()] == [(True, False), (True, False), (True, True)]
    times = [(1_700_000_000 + k * (90000 if k % 5 == 4 else 60), "ab"[k % 2], 10, 0) for k in range(40)]
    log = _log(spark, sorted(times)).withColumn("subject", F.explode(F.array(F.lit(0), F.lit(None).cast("int"))))
    for kind in ("base", "db", "ml"):
        cuts = {k: [r.closes for r in H.episodes(log, kind, 1.0, 0.1).orderBy("seq").collect() if r.subject == k] for k in (0, None)}
        assert cuts[0] == cuts[None] and sum(cuts[0]) >= 1
    assert {r.subject: r.average for r in H.gap_average(log).collect()}.keys() == {0, None}
    text = "The rain in spain falls.# " * 8
    docs = spark.createDataFrame([(1, text), (None, text), (2, None)], "doc_id long, text string")
    ranks = prism.sentence_ranks(docs, 10)
    total = {r.doc_id: r.total for r in ranks.groupBy("doc_id").agg(F.sum("rank").alias("total")).collect()}
    assert total[None] > 0 and total[1] > 0
    assert {r.doc_id for r in prism.selections(ranks, 10).collect()} == {None, 1}


def test_partners_like_pairs(spark):
    """Against all pairs of an episode."""
    rows = [(1_700_000_000 + 60 * k, f"u{(k * k) % 23 % (1 + k // 9)}", 1, 0) for k in range(150)]
    log = _log(spark, rows)
    spans = {}
    for k, (_, u, *_) in enumerate(rows, 1):
        spans[u] = (spans.get(u, (k, k))[0], k)
    expected = {u: sum(v != u and s <= e2 + 5 and s2 <= e + 5 for v, (s2, e2) in spans.items()) for u, (s, e) in spans.items()}
    assert {r.user: r.partners for r in H.interval_overlaps(log).collect()} == {u: n for u, n in expected.items() if n}


def test_running_average_over_blocks(spark):
    values = [None if k % 7 == 3 else float(k % 11) for k in range(100)]
    frame = spark.createDataFrame([(j, k, x) for j in (0, None) for k, x in enumerate(values)], "key int, k int, x double")
    expected = 5.0
    for x in values:
        expected = expected if x is None else 0.4 * expected + 0.6 * x
    for size in (1, 7, 1000):
        found = H.running_average(frame, ["key"], ["k"], F.floor(F.col("k") / size), "x", 5.0).collect()
        assert [r.average for r in found] == pytest.approx([expected] * 2) and [r.rows for r in found] == [100, 100]
