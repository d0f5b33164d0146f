"""What must not grow with a task's share of the input."""

import pickle

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import history as H
from tessera.plans import history_queries as HQ
from tessera.runtime import materialize
from tessera.streaming import online as S
from tests.oracle import SMALL


def test_learned_links_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(G, "SORTED", 10)
    rows = [(f"a{i % 40}", "PROMISES", f"b{i % 20}", float(i), i) for i in range(400)]
    found = G.learn_links(spark.createDataFrame(rows, "from_id string, semantics string, to_id string, weight double, seq int"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(from_id") == 1 and ", 40), REPARTITION_BY_NUM" in plan, plan
    expected = {}
    for a, s, b, w, _ in rows:
        expected[a, s, b] = 0.5 * w + 0.5 * expected.get((a, s, b), 0.0)
    assert {(r.from_id, r.semantics, r.to_id): r.weight for r in found.collect()} == expected


def test_assessed_texts_are_not_dealt(spark):
    plan = HQ.assess_changes(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and not any("added#" in line or "message#" in line for line in windows)
    changes = spark.createDataFrame([(1, "x" * 2000 + "http", "", "fine", 1.0), (2, "y", "z" * 50, "UNFAIR", 2.0), (3, None, None, None, 0.0)], "ord int, added string, removed string, message string, intent double")
    own = H.measure_changes(changes).withColumn("removed_bytes", F.octet_length(F.coalesce("removed", F.lit("")))).drop("added", "removed", "message")
    kept = ("ord", "assessment", "flags", "sigma")
    assert sorted(H.assess_changes(own).select(*kept).collect()) == sorted(H.assess_changes(changes).select(*kept).collect())


def test_waiting_rows_are_packed():
    n = 20_000
    r = np.random.default_rng(1)
    for column in (np.sort(r.integers(1 << 60, (1 << 60) + 10**13, n)), np.array([S.UNDATED, 0, 5]), r.random(n), np.array([None, "x"], object), np.zeros(0, np.int64)):
        assert S._opened(S._closed(column)).tolist() == column.tolist()
        assert column.dtype == object or len(pickle.dumps(S._closed(column))) < 200 + 9 * len(column)


def test_chains_are_written_once(spark, monkeypatch):
    written = []

    def counted(frame, name):
        out = materialize(frame, name)
        written.extend([out.count()] if name == "chain" else [])
        return out

    monkeypatch.setattr(G, "materialize", counted)
    rows = [("topic", "HEAD", "n00")] + [(f"n{i:02}", "THEN", f"n{i + 1:02}") for i in range(30)]
    links = spark.createDataFrame([("Follows", *r) for r in rows], "link_type string, from_id string, semantics string, to_id string")
    found = G.chain_from(links, "HEAD", None, "THEN", 20)
    assert {(r.hop, r.node) for r in found.collect()} == {(i + 1, f"n{i:02}") for i in range(20)}
    assert sum(written) == 20
