"""Queries over keyed stores, outbound traversals and text of single characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import history as H
from tessera.operators import stores as S
from tessera.plans import history_queries as HQ
from tessera.runtime import materialize, table


def _names(spark, sf_dir):
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(F.size(words).alias("n"), F.col("p_name").alias("raw"), F.col("p_retailprice").alias("value"), F.col("p_partkey").alias("seq"))


def ngram_store(spark, sf_dir):
    return S.save_ngrams(_names(spark, sf_dir)).select(F.col("n").cast("long").alias("n"), "key", "raw", "value")


def ngram_load(spark, sf_dir):
    return S.load_ngrams(S.save_ngrams(_names(spark, sf_dir))).select(F.col("n").cast("long").alias("n"), "key", "value")


def row_store(spark, sf_dir):
    return S.save_rows(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_totalprice"], "o_orderkey")


def point_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + (F.col("o_orderkey") % 3) * 1_000_000).alias("c_custkey"))
    return S.lookup(keys, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")


def overlay(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("v"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation")).agg((-F.count(F.lit(1))).alias("v"))
    return S.overlay(c, s, "nation", "v")


def _tree(spark, sf_dir):
    """region CONTAINS nation CONTAINS customer, customer THEN each of its orders: several targets a node."""
    def links(name, a, a_id, b, b_id, how):
        rows = table(spark, sf_dir, name)
        return rows.select(F.concat(F.lit(f"{a}/"), F.col(a_id).cast("string")).alias("from_id"), F.lit(how).alias("semantics"), F.concat(F.lit(f"{b}/"), F.col(b_id).cast("string")).alias("to_id"))

    made = links("nation", "region", "n_regionkey", "nation", "n_nationkey", "CONTAINS").union(links("customer", "nation", "c_nationkey", "customer", "c_custkey", "CONTAINS"))
    return made.union(links("orders", "customer", "o_custkey", "order", "o_orderkey", "THEN"))


def outbound(spark, sf_dir):
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("node"))
    return G.outbound(_tree(spark, sf_dir), starts).select("start", "node", F.col("hop").cast("long").alias("hop"))


def linked_types(spark, sf_dir):
    types = _tree(spark, sf_dir).groupBy("from_id").agg(F.collect_set("semantics").alias("types"))
    return types.select("from_id", S.has_link_type(F.col("types"), "THEN").alias("follows"))


def giant_clusters(spark, sf_dir):
    """Unions of users by bursts, as sizes; iterative, so a test holds it against a plain version."""
    found = H.episodes(HQ._log(spark, sf_dir), **HQ._options("db")).select("subject", "episode", "user").distinct()
    return S.cluster_histogram(S.burst_unions(materialize(found, "bursts"), ["subject", "episode"]))


def _runes(spark, sf_dir):
    text = F.translate("text", ".,()", "。，（）")
    return S.rune_sentences(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))


def rune_sentences(spark, sf_dir):
    return _runes(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).alias("characters"))


def rune_work(spark, sf_dir):
    strokes = spark.createDataFrame([(c, k + 1) for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")], "rune string, strokes int")
    work = S.rune_work(S.rune_tokens(_runes(spark, sf_dir)), strokes)
    return work.select("doc_id", F.col("s_idx").cast("long").alias("s_idx"), "tokens", "work")


QUERIES = {f.__name__: f for f in (ngram_store, ngram_load, row_store, point_lookup, overlay, outbound, linked_types, giant_clusters, rune_sentences, rune_work)}

_STORE = """s AS (SELECT CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n, lower(regexp_replace(substr(p_name, 1, 40), '[^a-zA-Z0-9]', '-', 'g')) AS key, arg_max(p_name, p_partkey) AS raw, arg_max(p_retailprice, p_partkey) AS value FROM part GROUP BY 1, 2)"""
_TREE = """tree AS (SELECT 'region/' || n_regionkey AS from_id, 'CONTAINS' AS semantics, 'nation/' || n_nationkey AS to_id FROM nation UNION ALL SELECT 'nation/' || c_nationkey, 'CONTAINS', 'customer/' || c_custkey FROM customer
UNION ALL SELECT 'customer/' || o_custkey, 'THEN', 'order/' || o_orderkey FROM orders)"""
_RUNES = """p AS (SELECT doc_id, string_split(translate(coalesce(text, ''), '.,()', '。，（）'), '。') AS x FROM documents), r AS (SELECT doc_id, unnest(x[1:len(x) - 1]) AS sentence, generate_subscripts(x[1:len(x) - 1], 1) AS s_idx FROM p)"""
ORACLES = {
    "ngram_store": f"WITH {_STORE} SELECT n, key, raw, value FROM s",
    "ngram_load": f"WITH {_STORE} SELECT n, key, value FROM s WHERE n BETWEEN 1 AND 6 QUALIFY row_number() OVER (PARTITION BY n ORDER BY key) <= 15000",
    "row_store": """WITH v AS (SELECT *, lag(o_orderkey) OVER w IS NOT NULL AND (lag(o_orderstatus) OVER w IS DISTINCT FROM o_orderstatus OR lag(o_totalprice) OVER w IS DISTINCT FROM o_totalprice) AS changed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_totalprice, o_orderkey) AS o_totalprice, CAST(sum(changed::INT) AS BIGINT) AS changes FROM v GROUP BY o_custkey""",
    "point_lookup": "SELECT o_orderkey, k AS c_custkey, c_name, c_custkey IS NOT NULL AS found FROM (SELECT o_orderkey, o_custkey + (o_orderkey % 3) * 1000000 AS k FROM orders) LEFT JOIN customer ON c_custkey = k",
    "overlay": """WITH c AS (SELECT c_nationkey AS nation, count(*) AS v FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS nation, -count(*) AS v FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT coalesce(s.nation, c.nation) AS nation, coalesce(s.v, c.v) AS v FROM c FULL JOIN s ON c.nation = s.nation""",
    "outbound": f"""WITH RECURSIVE {_TREE}, w AS (SELECT 'region/' || r_regionkey AS start, 'region/' || r_regionkey AS node, 0 AS hop FROM region UNION SELECT start, to_id, hop + 1 FROM w JOIN tree ON from_id = node WHERE hop < 200)
SELECT start, node, CAST(min(hop) AS BIGINT) AS hop FROM w WHERE hop > 0 GROUP BY start, node""",
    "linked_types": f"WITH {_TREE} SELECT from_id, bool_or(semantics = 'THEN') AS follows FROM tree GROUP BY from_id",
    "rune_sentences": f"WITH {_RUNES} SELECT doc_id, count(*) AS sentences, CAST(sum(length(sentence)) AS BIGINT) AS characters FROM r GROUP BY doc_id",
    "rune_work": f"""WITH {_RUNES}, t AS (SELECT doc_id, s_idx, string_split(regexp_replace(sentence, '[。，（）《》—]', '', 'g'), '') AS runes FROM r WHERE length(regexp_replace(sentence, '[。，（）《》—]', '', 'g')) > 0)
SELECT doc_id, CAST(s_idx AS BIGINT) AS s_idx, CAST(len(runes) AS BIGINT) AS tokens, list_sum(list_transform(runes, lambda c: CASE WHEN c BETWEEN 'a' AND 'z' AND length(c) = 1 AND unicode(c) BETWEEN 97 AND 122 THEN unicode(c) - 96 ELSE 0 END)) / 2.0::DOUBLE AS work FROM t""",
}
