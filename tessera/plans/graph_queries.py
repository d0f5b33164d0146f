"""Queries over typed links, contexts and fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import context as C
from tessera.functions import fits
from tessera.operators import graph as G
from tessera.operators import history as H
from tessera.operators.components import connected_components
from tessera.plans import history_queries as HQ
from tessera.plans import text_queries as TQ
from tessera.runtime import materialize, table


def _id(kind: str, column) -> object:
    return F.concat(F.lit(f"{kind}/"), column.cast("string"))


def _versions(spark, sf_dir):
    """Supplier PROMISES part, once for each line of an order; weight < 0 where the discount is high."""
    li = table(spark, sf_dir, "lineitem")
    weight = F.col("l_quantity") * F.when(F.col("l_discount") > 0.08, -1).otherwise(1)
    return li.select(_id("supplier", F.col("l_suppkey")).alias("from_id"), F.lit("PROMISES").alias("semantics"), _id("part", F.col("l_partkey")).alias("to_id"), weight.alias("weight"), F.lit(False).alias("negation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_extendedprice") / 1e7).alias("seq"))


VERSIONS = """v AS (SELECT 'supplier/' || l_suppkey AS from_id, 'PROMISES' AS semantics, 'part/' || l_partkey AS to_id, l_quantity * CASE WHEN l_discount > 0.08 THEN -1 ELSE 1 END AS weight, l_orderkey * 10 + l_linenumber + l_extendedprice / 1e7::DOUBLE AS seq FROM lineitem)"""


def _links(spark, sf_dir):
    """nation CONTAINS customer, an order THEN the customer's next, suppliers of a nation RELATED in a row."""
    c, o, s = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    one = F.lit(1.0)
    inside = G.make_links(c, _id("nation", F.col("c_nationkey")), F.lit("CONTAINS"), _id("customer", F.col("c_custkey")), one, keyed=False)
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    then = G.make_links(o.withColumn("before", F.lag("o_orderkey").over(w)), F.coalesce(_id("order", F.col("before")), _id("customer", F.col("o_custkey"))), F.lit("THEN"), _id("order", F.col("o_orderkey")), one, keyed=False)
    near = s.withColumn("before", F.lag("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))).filter("before is not null")
    related = G.make_links(near, _id("supplier", F.col("before")), F.lit("RELATED"), _id("supplier", F.col("s_suppkey")), one, keyed=False)
    return inside.union(then).union(related)


LINKS = """links AS (SELECT 'Contains' AS link_type, 'nation/' || c_nationkey AS from_id, 'CONTAINS' AS semantics, 'customer/' || c_custkey AS to_id FROM customer
UNION ALL SELECT 'Follows', coalesce('order/' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 'customer/' || o_custkey), 'THEN', 'order/' || o_orderkey FROM orders
UNION ALL SELECT 'Near', 'supplier/' || b, 'RELATED', 'supplier/' || s_suppkey FROM (SELECT s_suppkey, lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b FROM supplier) WHERE b IS NOT NULL)"""


def link_upsert(spark, sf_dir):
    return G.upsert_links(_versions(spark, sf_dir)).select("from_id", "to_id", "versions", "weight")


def learn_link(spark, sf_dir):
    return G.learn_links(_versions(spark, sf_dir)).select("from_id", "to_id", F.round("weight", 6).alias("weight"))


def incr_link(spark, sf_dir):
    return G.increment_links(_versions(spark, sf_dir)).select("from_id", "to_id", "weight")


def node_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = o.select(_id("customer", F.col("o_custkey")).alias("id"), F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderpriority")).alias("data"), F.when(F.col("o_orderstatus") == "O", 0.0).otherwise(F.col("o_totalprice")).alias("weight"), F.col("o_orderkey").alias("seq"))
    return G.upsert_nodes(v)


def kv_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))
    return G.upsert_values(o, ["k"], "v")


def link_keys(spark, sf_dir):
    links = _links(spark, sf_dir)
    return links.select("from_id", "to_id", G.link_key(F.col("from_id"), F.col("semantics"), F.col("to_id")).alias("key"))


def association_table(spark, sf_dir):
    return G.associations(spark)


def link_types(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("link_type", "semantics").agg(F.count(F.lit(1)).alias("links"))


def _neighbours(direction):
    def query(spark, sf_dir):
        found = G.neighbours(_links(spark, sf_dir), G.associations(spark), direction)
        return found.groupBy("node").agg(F.count(F.lit(1)).alias("neighbours"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("phrases")))), ",").alias("phrases"))

    return query


def adjacency_sparse(spark, sf_dir):
    return G.adjacency(_links(spark, sf_dir), "RELATED")


def power_iter3(spark, sf_dir):
    found = G.principal_eigenvector(G.adjacency(_links(spark, sf_dir), "RELATED"))
    return found.select("node", F.round("value", 10).alias("value"))


def matrix_vector(spark, sf_dir):
    m = G.adjacency(_links(spark, sf_dir), symmetric=True)
    ones = m.select(F.col("row").alias("node")).distinct().withColumn("value", F.length("node").cast("double"))
    return G.multiply(m, ones)


def components(spark, sf_dir):
    """Suppliers and parts that lines tie. Too many rows for recursive SQL: a test holds it against a plain version."""
    li = table(spark, sf_dir, "lineitem")
    return connected_components(li.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000_000).alias("b")))


def paths_from(spark, sf_dir):
    starts = table(spark, sf_dir, "nation").select(_id("nation", F.col("n_nationkey")).alias("node"))
    found = G.paths_from(_links(spark, sf_dir), starts)
    return found.select("start", F.array_join("path", ">").alias("path"), F.array_join("semantics", ">").alias("how"), F.col("length").cast("long").alias("length"))


def _episode_graph(spark, sf_dir):
    found = materialize(H.episodes(HQ._log(spark, sf_dir), **HQ._options("db")).select("subject", "episode", "user").distinct(), "episode-users")
    return G.episode_links(found.select("subject", "episode").distinct(), found)


def episode_chain(spark, sf_dir):
    links = _episode_graph(spark, sf_dir)
    return G.chain_from(links, "THEN", None, "THEN", 200).filter("start like 'topic/%'").select("start", F.col("hop").cast("long").alias("hop"), "node")


def episode_users(spark, sf_dir):
    links = _episode_graph(spark, sf_dir).filter("semantics = 'INFL'")
    return links.groupBy("to_id").agg(F.count(F.lit(1)).alias("users"))


def repeat_users(spark, sf_dir):
    found = H.episodes(HQ._log(spark, sf_dir), **HQ._options("db")).groupBy("subject", "user").agg(F.count_distinct("episode").alias("episodes"))
    return found.filter("episodes > 1").groupBy("subject").agg(F.count(F.lit(1)).alias("users"), F.max("episodes").alias("most"))


def story_tail(spark, sf_dir):
    return G.chain_from(_links(spark, sf_dir), "THEN", "Follows", hops=200).filter("start like 'customer/%'").select("start", F.col("hop").cast("long").alias("hop"), "node")


def signal_users(spark, sf_dir):
    roles = H.user_roles(HQ._log(spark, sf_dir))
    return G.signal_links(roles).select("from_id", "to_id", "link_type")


def contentious_share(spark, sf_dir):
    """Of each subject's users: the share of all contentious users, and of its own."""
    roles = materialize(H.user_roles(HQ._log(spark, sf_dir)), "roles")
    n = roles.filter("role = 'contentious'").select("user").distinct().count()
    users = HQ._log(spark, sf_dir).groupBy("subject").agg(F.count_distinct("user").alias("users"))
    own = roles.filter("role = 'contentious'").groupBy("subject").agg(F.count(F.lit(1)).alias("own"))
    return users.join(own, "subject", "left").select("subject", "users", F.round(100.0 * n / F.col("users"), 6).alias("all_percent"), F.round(100.0 * F.coalesce("own", F.lit(0)) / F.col("users"), 6).alias("own_percent"))


def topic_graph(spark, sf_dir):
    found = G.topic_links(TQ.text_prism_topics(spark, sf_dir))
    return found.groupBy("semantics", F.regexp_extract("from_id", "^[^/]*", 0).alias("from_kind"), F.regexp_extract("to_id", "^[^/]*", 0).alias("to_kind")).agg(F.count(F.lit(1)).alias("links"))


def topics_by_fraction(spark, sf_dir):
    """How many topics have each concept of 2 to 5 words."""
    found = TQ.text_prism_topics(spark, sf_dir).filter("n between 2 and 5")
    return found.groupBy("ngram").agg(F.count_distinct("doc_id").alias("topics"))


EXPRESSIONS = {
    "x1": "click & (error | view)", "x2": "(click & (error | view))|(error.view.signup)", "x3": "!click", "x4": "nosuch | purchase", "x5": "!(nosuch | !view)", "x6": "!nosuch & click",
}


def context_eval(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("share", F.lit(0.1))
    contexts = C.context_map(e, "user_id", "event_type", "share")
    return contexts.select("user_id", F.array_join(C.active_symbols(F.col("context")), ",").alias("symbols"), *[F.round(C.compile_expression(x, C.in_map(F.col("context"))), 6).alias(k) for k, x in EXPRESSIONS.items()])


def nav(spark, sf_dir):
    return fits.mean_size(H.episode_table(HQ._log(spark, sf_dir), **HQ._options("db")), "users").select(F.round("mean", 8).alias("mean"))


def nexpect(spark, sf_dir):
    return fits.expected_size(HQ.cluster_hist(spark, sf_dir)).select(F.round("expected", 5).alias("expected"))


def ncurve(spark, sf_dir):
    return fits.rounded_counts(H.episode_table(HQ._log(spark, sf_dir), **HQ._options("db")).withColumn("x", F.col("users") / 3), "x")


def curve_fit(spark, sf_dir):
    return fits.group_curve(spark).select("n", "mean", F.round("f", 10).alias("f"))


def hierarchy(spark, sf_dir):
    return fits.hierarchy(spark).select("beta", "level", F.round("size", 6).alias("size"))


QUERIES = {f"neighbours_{d}": _neighbours(d) for d in ("out", "in", "both")} | {
    f.__name__: f
    for f in (
        link_upsert, learn_link, incr_link, node_upsert, kv_upsert, link_keys, association_table, link_types, adjacency_sparse, power_iter3, matrix_vector, components, paths_from, episode_chain, episode_users, repeat_users,
        story_tail, signal_users, contentious_share, topic_graph, topics_by_fraction, context_eval, nav, nexpect, ncurve, curve_fit, hierarchy,
    )
}

_VOCABULARY = "voc(semantics, fwd, bwd) AS (VALUES " + ", ".join("('{}', '{}', '{}')".format(k, *(x.replace("'", "''") for x in (f, b))) for k, _, f, b, *_ in G.ASSOCIATIONS) + ")"
_OUT = "SELECT from_id AS node, to_id AS neighbour, fwd AS phrase FROM links JOIN voc USING (semantics)"
_IN = "SELECT to_id AS node, from_id AS neighbour, bwd AS phrase FROM links JOIN voc USING (semantics)"


def _near(rows: str) -> str:
    return f"WITH {LINKS}, {_VOCABULARY}, n AS ({rows}) SELECT node, count(DISTINCT neighbour) AS neighbours, string_agg(DISTINCT phrase, ',' ORDER BY phrase) AS phrases FROM n GROUP BY node"


_RELATED = "m AS (SELECT DISTINCT r AS row, c AS col FROM (SELECT from_id AS r, to_id AS c FROM links WHERE semantics = 'RELATED' UNION ALL SELECT to_id, from_id FROM links WHERE semantics = 'RELATED'))"
_EPISODE = HQ._episodes("db")
_ROLES = f"WITH {HQ.UNDOS}{HQ._ROLES}"
ORACLES = {
    "neighbours_out": _near(_OUT),
    "neighbours_in": _near(_IN),
    "neighbours_both": _near(f"{_OUT} UNION ALL {_IN}"),
    "link_upsert": f"WITH {VERSIONS} SELECT from_id, to_id, count(*) AS versions, coalesce(arg_max(weight, seq) FILTER (weight >= 0), arg_min(weight, seq)) AS weight FROM v GROUP BY from_id, to_id",
    "learn_link": f"WITH {VERSIONS} SELECT from_id, to_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(weight ORDER BY seq)), lambda a, x: 0.5::DOUBLE * x + 0.5::DOUBLE * a), 6) AS weight FROM v GROUP BY from_id, to_id",
    "incr_link": f"WITH {VERSIONS} SELECT from_id, to_id, (count(*) - 1)::DOUBLE AS weight FROM v GROUP BY from_id, to_id",
    "node_upsert": """WITH v AS (SELECT 'customer/' || o_custkey AS id, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderpriority END AS data, CASE WHEN o_orderstatus = 'O' THEN 0.0 ELSE o_totalprice END AS weight, o_orderkey AS seq FROM orders)
SELECT id, coalesce(arg_max(data, seq) FILTER (NOT (data = '' AND weight = 0)), arg_min(data, seq)) AS data, coalesce(arg_max(weight, seq) FILTER (NOT (data = '' AND weight = 0)), arg_min(weight, seq)) AS weight FROM v GROUP BY id""",
    "kv_upsert": "SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1",
    "link_keys": f"""WITH {LINKS} SELECT from_id, to_id, 'key_' || CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(from_id || semantics || to_id, ''), lambda c: ascii(c)::HUGEINT)),
lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616) AS VARCHAR) AS key FROM links""",
    "link_types": f"WITH {LINKS} SELECT link_type, semantics, count(*) AS links FROM links GROUP BY ALL",
    "adjacency_sparse": f"WITH {LINKS}, {_RELATED} SELECT row, col, 1.0::DOUBLE AS val FROM m",
    "power_iter3": f"""WITH {LINKS}, {_RELATED}, v1 AS (SELECT row AS node, count(*)::DOUBLE AS v FROM m GROUP BY row), v2 AS (SELECT row AS node, sum(v) AS v FROM m JOIN v1 ON col = node GROUP BY row),
v3 AS (SELECT row AS node, sum(v) AS v FROM m JOIN v2 ON col = node GROUP BY row) SELECT node, round(v / sum(v) OVER (), 10) AS value FROM v3""",
    "matrix_vector": f"""WITH {LINKS}, m AS (SELECT DISTINCT r AS row, c AS col FROM (SELECT from_id AS r, to_id AS c FROM links UNION ALL SELECT to_id, from_id FROM links)) SELECT row AS node, sum(length(col)::DOUBLE) AS value FROM m GROUP BY row""",
    "paths_from": f"""WITH RECURSIVE {LINKS}, p AS (SELECT 'nation/' || n_nationkey AS start, ['nation/' || n_nationkey] AS path, []::VARCHAR[] AS how FROM nation
UNION ALL SELECT start, list_append(path, to_id), list_append(how, semantics) FROM p JOIN links ON from_id = path[-1] WHERE len(how) < 4 AND NOT list_contains(path, to_id))
SELECT start, array_to_string(path, '>') AS path, array_to_string(how, '>') AS how, len(how) AS length FROM p WHERE len(how) = 4 OR NOT EXISTS (SELECT 1 FROM links WHERE from_id = p.path[-1] AND NOT list_contains(p.path, to_id))""",
    "episode_chain": f"WITH RECURSIVE {_EPISODE} SELECT DISTINCT 'topic/' || subject AS start, episode::BIGINT AS hop, 'episode/' || subject || '_ep_' || episode AS node FROM ep WHERE episode <= 200",
    "episode_users": f"""WITH RECURSIVE {_EPISODE} SELECT 'episode/' || subject || '_ep_' || episode AS to_id, count(DISTINCT "user") AS users FROM ep GROUP BY 1""",
    "repeat_users": f"""WITH RECURSIVE {_EPISODE}, u AS (SELECT subject, "user", count(DISTINCT episode) AS n FROM ep GROUP BY subject, "user") SELECT subject, count(*) AS users, max(n) AS most FROM u WHERE n > 1 GROUP BY subject""",
    "story_tail": "SELECT 'customer/' || o_custkey AS start, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS hop, 'order/' || o_orderkey AS node FROM orders QUALIFY hop <= 200",
    "signal_users": f"""{_ROLES} SELECT DISTINCT 'user/' || "user" AS from_id, 'signal/' || role AS to_id, 'Expresses' AS link_type FROM roles WHERE role IS NOT NULL""",
    "contentious_share": f"""{_ROLES}, n AS (SELECT count(DISTINCT "user") AS n FROM roles WHERE role = 'contentious'), u AS (SELECT subject, count(DISTINCT "user") AS users FROM log GROUP BY subject), o AS (SELECT subject, count(*) AS own FROM roles WHERE role = 'contentious' GROUP BY subject)
SELECT subject, users, round(100.0::DOUBLE * n / users, 6) AS all_percent, round(100.0::DOUBLE * coalesce(own, 0) / users, 6) AS own_percent FROM u LEFT JOIN o USING (subject), n""",
    "topic_graph": f"""WITH {TQ.TOPICS}, ph AS (SELECT DISTINCT ngram, string_split(ngram, ' ') AS w FROM topics), pt AS (SELECT ngram, w, unnest(range(1, len(w) + 1)) AS n FROM ph), sp AS (SELECT ngram, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM pt),
sub AS (SELECT DISTINCT ngram, len(w) AS k, n, array_to_string(w[i : i + n - 1], ' ') AS part FROM sp), x AS (SELECT 'TALKSABOUT' AS semantics, 'topic' AS from_kind, 'ngram' || len(string_split(ngram, ' ')) AS to_kind FROM topics
UNION ALL SELECT 'CONTAINS', 'ngram' || k, 'ngram' || n FROM sub WHERE part <> ngram) SELECT semantics, from_kind, to_kind, count(*) AS links FROM x GROUP BY ALL""",
    "topics_by_fraction": f"WITH {TQ.TOPICS} SELECT ngram, count(DISTINCT doc_id) AS topics FROM topics WHERE n BETWEEN 2 AND 5 GROUP BY ngram",
    "context_eval": """WITH e AS (SELECT user_id, event_type, sum(0.1::DOUBLE) AS w FROM events GROUP BY ALL), p AS (SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS symbols, coalesce(max(w) FILTER (event_type = 'click'), 0) AS c, coalesce(max(w) FILTER (event_type = 'error'), 0) AS r,
coalesce(max(w) FILTER (event_type = 'view'), 0) AS v, coalesce(max(w) FILTER (event_type = 'signup'), 0) AS s, coalesce(max(w) FILTER (event_type = 'purchase'), 0) AS p FROM e GROUP BY user_id)
SELECT user_id, symbols, round(c * (r + v), 6) AS x1, round(c * (r + v) + r * v * s, 6) AS x2, CASE WHEN c > 0 THEN 0.0::DOUBLE ELSE 1 END AS x3, round(p, 6) AS x4, CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END AS x5, round(c, 6) AS x6 FROM p""",
    "nav": f"WITH RECURSIVE {_EPISODE} SELECT round(avg(users), 8) AS mean FROM et",
    "nexpect": f"WITH RECURSIVE {_EPISODE} SELECT round(avg(users), 5) AS expected FROM et",
    "ncurve": f"WITH RECURSIVE {_EPISODE}, c AS (SELECT CAST(floor(users / 3.0::DOUBLE + 0.5) AS BIGINT) AS n, count(*) AS c FROM et GROUP BY 1) SELECT i AS n, coalesce(c, 0) * 600.0::DOUBLE AS scaled FROM range(1, 15) r(i) LEFT JOIN c ON c.n = i",
    "curve_fit": "SELECT i AS n, m::DOUBLE AS mean, round(4 * sqrt(2 * (i - 1) / m::DOUBLE) * exp(-2 * (i - 1) / m::DOUBLE) / (m * 1.77::DOUBLE), 10) AS f FROM range(1, 41) r(i), unnest([4, 8, 30, 150, 500]) t(m)",
    "hierarchy": "WITH RECURSIVE l AS (SELECT b::DOUBLE AS beta, 0 AS level, 5.0::DOUBLE AS size FROM unnest([1.0, 0.93]) t(b) UNION ALL SELECT beta, level + 1, (size - 1) * 4 * beta FROM l WHERE (size - 1) * 4 * beta <= 600) SELECT beta, level, round(size, 6) AS size FROM l",
}
ORACLES["association_table"] = "SELECT * FROM (VALUES " + ", ".join("('{}', {}, '{}', '{}', '{}', '{}')".format(k, t, *(x.replace("'", "''") for x in rest)) for k, t, *rest in G.ASSOCIATIONS) + ") AS t(key, st_type, fwd, bwd, nfwd, nbwd)"
