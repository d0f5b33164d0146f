"""Iterative queries and stores against plain Python, on the smallest tables and on odd rows."""

import collections


from tessera.operators import graph, stores
from tessera.operators import history as H
from tessera.plans import history_queries as HQ
from tessera.plans.queries import QUERIES
from tests.oracle import SMALL


def united(pairs):
    label = {}

    def find(i):
        label.setdefault(i, i)
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {i: find(i) for i in label}


def test_components_of_all_lines(spark):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()
    expected = united((r.l_suppkey, r.l_partkey + 1_000_000_000) for r in lines)
    assert {r.node: r.component for r in QUERIES["components"](spark, SMALL).collect()} == expected


def test_giant_clusters(spark):
    found = H.episodes(HQ._log(spark, SMALL), **HQ._options("db")).select("subject", "episode", "user").distinct().collect()
    first = {}
    for r in found:
        first.setdefault((r.subject, r.episode), r.user)
    label = united((r.user, first[r.subject, r.episode]) for r in found)
    alone = {r.user for r in found} - {u for r in found for u in (r.user, first[r.subject, r.episode]) if r.user != first[r.subject, r.episode]}
    sizes = collections.Counter(collections.Counter(v for k, v in label.items() if k not in alone).values())
    assert {r.size: r.clusters for r in QUERIES["giant_clusters"](spark, SMALL).collect()} == sizes


def test_outbound(spark):
    """Branches, a cycle, a chain and a start that leads nowhere."""
    links = spark.createDataFrame([("t", "a"), ("a", "b"), ("a", "c"), ("c", "d"), ("d", "a"), ("d", "t"), ("x", "x"), (None, "a"), ("b", None)], "from_id string, to_id string")
    starts = spark.createDataFrame([("t",), ("x",), ("none",), ("t",)], "node string")
    found = {(r.start, r.node): r.hop for r in graph.outbound(links, starts).collect() if r.node}
    assert found == {("t", "a"): 1, ("t", "b"): 2, ("t", "c"): 2, ("t", "d"): 3}
    assert {r.node for r in graph.outbound(links, starts, hops=1).collect()} == {"a"}
    assert graph.outbound(links.filter("from_id = 'no'"), starts).count() == 0


def test_stores(spark):
    counts = spark.createDataFrame([(2, "a b", 1.0, 1), (2, "a-b", 2.0, 2), (1, "a", 3.0, 3), (1, None, 4.0, 4)], "n int, raw string, value double, seq int")
    store = stores.save_ngrams(counts)
    assert {(r.n, r.key): (r.raw, r.value) for r in store.collect()} == {(2, "a-b"): ("a-b", 2.0), (1, "a"): ("a", 3.0), (1, None): (None, 4.0)}
    assert stores.load_ngrams(store, limit=1).count() == 2
    rows = spark.createDataFrame([("k", 1, 1), ("k", 1, 2), ("k", 2, 3), (None, 5, 1)], "key string, v int, seq int")
    assert {r.key: (r.v, r.changes) for r in stores.save_rows(rows, "key", ["v"]).collect()} == {"k": (2, 1), None: (5, 0)}
    found = stores.lookup(spark.createDataFrame([("k",), ("no",), (None,)], "key string"), stores.save_rows(rows, "key", ["v"]), "key")
    assert {r.key: (r.v, r.found) for r in found.collect()} == {"k": (2, True), "no": (None, False), None: (None, False)}
    top = stores.overlay(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", None), ("c", 3)], "k string, v int"), "k", "v")
    assert {r.k: r.v for r in top.collect()} == {"a": 1, "b": None, "c": 3}


def test_runes(spark):
    docs = spark.createDataFrame([(1, "中文，好。再见。尾"), (2, None), (3, ""), (4, "没有")], "doc_id long, text string")
    sentences = stores.rune_sentences(docs)
    assert [(r.doc_id, r.s_idx, r.sentence) for r in sentences.orderBy("s_idx").collect()] == [(1, 1, "中文，好"), (1, 2, "再见")]
    strokes = spark.createDataFrame([("中", 4), ("文", 4), ("好", 6), ("再", 6)], "rune string, strokes int")
    work = stores.rune_work(stores.rune_tokens(sentences), strokes).orderBy("s_idx").collect()
    assert [(r.tokens, r.work) for r in work] == [(3, 7.0), (2, 3.0)]


def test_running_mean_over_blocks(spark, monkeypatch):
    """The mean runs over all subjects, across the borders of blocks."""
    monkeypatch.setattr(H, "AVERAGED", 70)
    rows = [(k % 3, 5 * k, "", "", "", float(k * k % 17)) for k in range(400)]
    frame = spark.createDataFrame(rows, "subject int, ord long, added string, removed string, message string, intent double")
    found, mean = {r.ord: r.sigma for r in H.assess_changes(frame).select("ord", "sigma").collect()}, 0.0
    for r in rows:
        mean = 0.5 * mean + 0.5 * r[5]
        assert abs(found[r[1]] - (abs(r[5] - mean) / abs(mean) if mean else 0)) < 1e-9
