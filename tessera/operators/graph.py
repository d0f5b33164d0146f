"""A typed graph in two tables: nodes (kind, key, id, data, weight, gap_ns, begin_ns, end_ns) and links
(link_type, from_id, to_id, semantics, negation, weight, key).

Upserts are last-wins aggregates over versions with a seq, so loading is idempotent and needs no table format with
row updates. Chains and paths are bounded walks that end when nothing is left to follow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tessera.runtime import materialize, release

KINDS = ("topic", "ngram1", "ngram2", "ngram3", "ngram4", "ngram5", "ngram6", "event", "episode", "user", "signal")
LINK_TYPES = ("none", "Follows", "Contains", "Expresses", "Near")
# Association, signed type, and the phrases forward, backward, not forward, not backward.
ASSOCIATIONS = (
    ("CONTAINS", 2, "contains", "belongs to or is part of", "does not contain", "is not part of"),
    ("TALKSABOUT", 2, "talks about", "is discussed in", "doesn't obviously contain", "is not obviously part of"),
    ("INVOLVES", 2, "involves", "is discussed in", "doesn't obviously involve", "is not obviously part of"),
    ("GENERALIZES", 2, "generalizes", "is a special case of", "is not a generalization of", "is not a special case of"),
    ("PART_OF", -2, "incorporates", "is part of", "is not part of", "doesn't contribute to"),
    ("HAS_ROLE", 3, "has the role of", "is a role fulfilled by", "has no role", "is not a role fulfilled by"),
    ("EXPRESSES", 3, "expresses an attribute", "is an attribute of", "has no attribute", "is not an attribute of"),
    ("PROMISES", 3, "promises/intends", "is intended/promised by", "rejects/promises to not", "is rejected by"),
    ("HAS_NAME", 3, "has proper name", "is the proper name of", "is not named", "isn't the proper name of"),
    ("FOLLOWS_FROM", 1, "follows on from", "is followed by", "does not follow", "does not precede"),
    ("USES", 1, "uses", "is used by", "does not use", "is not used by"),
    ("CAUSEDBY", 1, "caused by", "may cause", "was not caused by", "probably didn't cause"),
    ("DERIVES_FROM", 1, "derives from", "leads to", "does not derive from", "does not leadto"),
    ("INFL", 1, "influenced", "was influenced by", "didn't influence", "not influenced by"),
    ("NEXT", -1, "comes before", "comes after", "is not before", "is not after"),
    ("THEN", -1, "then", "previously", "but not", "didn't follow"),
    ("LEADS_TO", -1, "leads to", "doesn't imply", "doen't reach", "doesn't precede"),
    ("PRECEDES", -1, "precedes", "follows", "doen't precede", "doesn't precede"),
    ("RELATED", 4, "may be related to", "may be related to", "likely unrelated to", "likely unrelated to"),
    ("ALIAS", 4, "also known as", "also known as", "not known as", "not known as"),
    ("IS_LIKE", 4, "is similar to", "is similar to", "is unlike", "is unlike"),
    ("CONNECTED", 4, "is connected to", "is connected to", "is not connected to", "is not connected to"),
    ("COACTIV", 4, "occurred together with", "occurred together with", "never appears with", "never appears with"),
)
TYPES = {name: kind for name, kind, *_ in ASSOCIATIONS}


def associations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASSOCIATIONS, "key string, st_type int, fwd string, bwd string, nfwd string, nbwd string")


def link_type(semantics: Column) -> Column:
    """The collection of an association; an unknown one stops the query."""
    types = F.create_map(*[F.lit(x) for k, v in TYPES.items() for x in (k, LINK_TYPES[abs(v)])])
    return F.coalesce(F.try_element_at(types, semantics), F.raise_error(F.concat(F.lit("unknown association: "), semantics)).cast("string"))


@pandas_udf(StringType())
def fnv1a64(s):
    """FNV-1a of the UTF-8 bytes, 64 bits, in decimal: no built-in function has it."""
    import numpy as np

    out = np.full(len(s), 14695981039346656037, np.uint64)
    raw = [x.encode() if x is not None else None for x in s]
    longest = max((len(x) for x in raw if x is not None), default=0)
    size = np.array([len(x) if x is not None else 0 for x in raw])
    grid = np.zeros((len(raw), longest), np.uint8)
    for i, x in enumerate(raw):
        if x:
            grid[i, : len(x)] = np.frombuffer(x, np.uint8)
    for k in range(longest):
        on = size > k
        out[on] = (out[on] ^ grid[on, k]) * np.uint64(1099511628211)
    import pandas as pd

    return pd.Series([None if x is None else str(int(h)) for x, h in zip(raw, out, strict=True)])


def link_key(from_id: Column, semantics: Column, to_id: Column) -> Column:
    return F.concat(F.lit("key_"), fnv1a64(F.concat(from_id, semantics, to_id)))


def make_nodes(frame: DataFrame, kind: Column, key: Column, data: Column, **more: Column) -> DataFrame:
    """Nodes; a kind that is none of the eleven stops the query."""
    known = F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), kind)).cast("string"))
    extra = {"weight": F.lit(0.0), "gap_ns": F.lit(0).cast("long"), "begin_ns": F.lit(0).cast("long"), "end_ns": F.lit(0).cast("long")} | more
    return frame.select(known.alias("kind"), key.alias("key"), F.concat(kind, F.lit("/"), key).alias("id"), data.alias("data"), *[c.alias(n) for n, c in extra.items()])


def make_links(frame: DataFrame, from_id: Column, semantics: Column, to_id: Column, weight: Column, negation: bool = False, keyed: bool = True) -> DataFrame:
    a, b = F.replace(from_id, F.lit(" "), F.lit("_")), F.replace(to_id, F.lit(" "), F.lit("_"))
    made = frame.select(link_type(semantics).alias("link_type"), a.alias("from_id"), b.alias("to_id"), semantics.alias("semantics"), F.lit(negation).alias("negation"), weight.cast("double").alias("weight"))
    return made.withColumn("key", link_key(F.col("from_id"), F.col("semantics"), F.col("to_id"))) if keyed else made


EDGE = ["from_id", "semantics", "to_id"]
#: Versions of links that a task sorts, about.
SORTED = 500_000


def upsert_links(versions: DataFrame, seq: str = "seq") -> DataFrame:
    """The last version of each edge; one of negative weight never replaces an existing edge."""
    first = F.min_by(F.struct("weight", "negation"), seq)
    last = F.max_by(F.struct("weight", "negation"), F.when(F.col("weight") >= 0, F.col(seq)))
    chosen = F.coalesce(last, first)
    return versions.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("versions"), chosen.alias("c")).select(*EDGE, "versions", "c.weight", "c.negation")


def upsert_nodes(versions: DataFrame, seq: str = "seq") -> DataFrame:
    """The last version of each node; one without data and weight never replaces an existing node."""
    empty = (F.coalesce("data", F.lit("")) == "") & (F.coalesce("weight", F.lit(0.0)) == 0)
    chosen = F.coalesce(F.max_by(F.struct("data", "weight"), F.when(~empty, F.col(seq))), F.min_by(F.struct("data", "weight"), seq))
    return versions.groupBy("id").agg(chosen.alias("c")).select("id", "c.data", "c.weight")


def upsert_values(versions: DataFrame, keys: list[str], value: str, seq: str = "seq") -> DataFrame:
    """The last value of each key."""
    return versions.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def learn_links(versions: DataFrame, seq: str = "seq") -> DataFrame:
    """Half of each weight and half of what was, from 0, in order; null weights are passed over."""
    after = F.count("weight").over(Window.partitionBy(*EDGE).orderBy(F.desc(seq), F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1))
    # So many edges to a task that its sort is of a bounded size, however many there are.
    own = versions.select(*EDGE, seq, "weight")
    dealt = own.repartition(max(math.ceil(own.count() / SORTED), int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "from_id", "to_id")
    weighed = dealt.withColumn("after", F.coalesce(after, F.lit(0)))
    return weighed.groupBy(*EDGE).agg(F.coalesce(F.sum(F.pow(F.lit(0.5), F.col("after") + 1) * F.col("weight")), F.lit(0.0)).alias("weight"))


def increment_links(versions: DataFrame) -> DataFrame:
    """Each edge by how often it came after the first time."""
    return versions.groupBy(*EDGE).agg((F.count(F.lit(1)) - 1).cast("double").alias("weight"))


def neighbours(links: DataFrame, words: DataFrame, direction: str = "out") -> DataFrame:
    """node, neighbour, phrases: who is linked to whom, and how it is said; direction out, in or both."""
    vocabulary = F.broadcast(words.select(F.col("key").alias("semantics"), "fwd", "bwd"))  # 23 rows
    said = links.filter(~F.col("negation")).join(vocabulary, "semantics")
    out = said.select(F.col("from_id").alias("node"), F.col("to_id").alias("neighbour"), F.col("fwd").alias("phrase"))
    back = said.select(F.col("to_id").alias("node"), F.col("from_id").alias("neighbour"), F.col("bwd").alias("phrase"))
    rows = {"out": out, "in": back, "both": out.union(back)}[direction]
    return rows.groupBy("node", "neighbour").agg(F.array_sort(F.collect_set("phrase")).alias("phrases"))


def adjacency(links: DataFrame, semantics: str | None = None, symmetric: bool = False) -> DataFrame:
    """row, col, val = 1: a sparse matrix of one association, or of all; NEAR ones are symmetric."""
    some = links.filter(F.col("semantics") == semantics) if semantics else links
    pairs = some.select(F.col("from_id").alias("row"), F.col("to_id").alias("col"))
    if symmetric or (semantics and abs(TYPES[semantics]) == 4):
        pairs = pairs.union(pairs.select("col", "row"))
    return pairs.distinct().withColumn("val", F.lit(1.0))


def multiply(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """node, value: the matrix times a vector (node, value)."""
    return matrix.join(vector, F.col("col") == F.col("node")).groupBy("row").agg(F.sum(F.col("val") * F.col("value")).alias("value")).withColumnRenamed("row", "node")


def principal_eigenvector(matrix: DataFrame, rounds: int = 3) -> DataFrame:
    """node, value: after so many power iterations from ones, by its sum (by 1 where that is 0)."""
    nodes = matrix.select(F.col("row").alias("node")).union(matrix.select("col")).distinct()
    vector = nodes.withColumn("value", F.lit(1.0))
    for _ in range(rounds):
        vector = nodes.join(multiply(matrix, vector), "node", "left").select("node", F.coalesce("value", F.lit(0.0)).alias("value"))
    vector = materialize(vector, "eigen")
    total = vector.agg(F.sum(F.abs("value"))).first()[0] or 1.0  # one number
    return vector.withColumn("value", F.col("value") / F.lit(float(total)))


def paths_from(links: DataFrame, starts: DataFrame, depth: int = 4) -> DataFrame:
    """start, path (nodes), semantics, length: all ways without a repeated node that cannot go on, or reach the depth."""
    edges = links.select(F.col("from_id").alias("here"), F.col("to_id").alias("there"), F.col("semantics").alias("how")).distinct()
    open_ = starts.select(F.col("node").alias("start"), F.array("node").alias("path"), F.array().cast("array<string>").alias("semantics"))
    done = None
    for step in range(depth):
        moved = open_.withColumn("here", F.element_at("path", -1)).join(edges, "here", "left")
        onward = F.col("there").isNotNull() & ~F.array_contains("path", F.coalesce("there", F.lit("")))
        moved = materialize(moved.withColumn("onward", onward), "paths")
        grown = moved.filter("onward").select("start", F.array_append("path", F.col("there")).alias("path"), F.array_append("semantics", F.col("how")).alias("semantics"))
        stuck = moved.groupBy("start", "path", "semantics").agg(F.max("onward").alias("any")).filter(~F.col("any")).select("start", "path", "semantics")
        done = stuck if done is None else done.union(stuck)
        open_ = grown
        if step == depth - 1 or not grown.limit(1).count():
            break
    return done.union(open_).withColumn("length", F.size("semantics"))


def chain_from(links: DataFrame, start_semantics: str, walk_type: str | None, semantics: str | None = None, hops: int = 200) -> DataFrame:
    """start, hop, node: each start's chain. Heads by one association (the smallest target), then every link of a type or
    association, at most so many hops; a walk that comes back to a node ends there.

    Chains are found by doubling: links are squared until none is longer, so 200 hops take 8 rounds, not 200.
    """
    step = links.filter(F.col("semantics") == semantics) if semantics else links.filter(F.col("link_type") == walk_type)
    nxt = materialize(step.groupBy(F.col("from_id").alias("node")).agg(F.min("to_id").alias("next")), "next")
    heads = links.filter(F.col("semantics") == start_semantics).groupBy(F.col("from_id").alias("start")).agg(F.min("to_id").alias("node"))
    chain = materialize(heads.withColumn("hop", F.lit(1)), "chain")
    jump, length = nxt, 1
    while length < hops:
        # Every node so far, moved on by the length covered; what is known is written once.
        more = chain.join(jump, "node").select("start", F.col("next").alias("node"), (F.col("hop") + length).alias("hop")).filter(F.col("hop") <= hops)
        chain = chain.unionByName(materialize(more, "chain"))
        length *= 2
        if length >= hops:
            break
        after = materialize(jump.join(jump.select(F.col("node").alias("next"), F.col("next").alias("after")), "next").select("node", F.col("after").alias("next")), "jump")
        release(jump)
        jump = after
        if not jump.limit(1).count():
            break
    first = chain.groupBy("start", "node").agg(F.min("hop").alias("hop"))
    return first.select("start", "hop", "node")


def outbound(links: DataFrame, starts: DataFrame, hops: int = 200) -> DataFrame:
    """start, node, hop: all nodes that each start (node) leads to along links, whatever branches, with the fewest hops.

    A node is reached once, so cycles end; a start is not its own target. Each hop moves only what is new, and the last is
    the first that finds nothing.
    """
    edges = materialize(links.select(F.col("from_id").alias("node"), F.col("to_id").alias("next")).distinct(), "steps")
    seen = frontier = materialize(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hop")).distinct(), "reached")
    for hop in range(1, hops + 1):
        moved = frontier.join(edges, "node").select("start", F.col("next").alias("node"), F.lit(hop).alias("hop")).distinct()
        frontier = materialize(moved.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", "hop"), "reached")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("hop > 0")


def episode_links(episodes: DataFrame, users: DataFrame) -> DataFrame:
    """Links of subjects' episodes (subject, episode) and their users (subject, episode, user): topic THEN the first, each THEN the next, user INFL episode."""
    name = F.concat(F.lit("episode/"), F.col("subject").cast("string"), F.lit("_ep_"), F.col("episode").cast("string"))
    before = F.concat(F.lit("episode/"), F.col("subject").cast("string"), F.lit("_ep_"), (F.col("episode") - 1).cast("string"))
    topic = F.concat(F.lit("topic/"), F.col("subject").cast("string"))
    one = F.lit(1.0)
    chain = make_links(episodes, F.when(F.col("episode") == 1, topic).otherwise(before), F.lit("THEN"), name, one, keyed=False)
    people = make_links(users, F.concat(F.lit("user/"), F.col("user")), F.lit("INFL"), name, one, keyed=False)
    return chain.union(people)


def signal_links(roles: DataFrame) -> DataFrame:
    """user EXPRESSES signal, of roles (user, role)."""
    some = roles.filter("role is not null").select("user", "role").distinct()
    return make_links(some, F.concat(F.lit("user/"), F.col("user")), F.lit("EXPRESSES"), F.concat(F.lit("signal/"), F.col("role")), F.lit(1.0), keyed=False)


def sub_ngrams(phrases: DataFrame, phrase: str = "ngram") -> DataFrame:
    """phrase, part, n: the runs of words of a phrase, shorter than it."""
    w = F.split(F.col(phrase), " ")
    parts = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(w)),
            lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.struct(n.alias("n"), F.array_join(F.slice(w, i, n), " ").alias("part"))),
        )
    )
    return phrases.select(F.col(phrase).alias("phrase"), F.explode(parts).alias("p")).select("phrase", "p.part", "p.n").filter("part <> phrase").distinct()


def topic_links(topics: DataFrame) -> DataFrame:
    """Links of persistent concepts (doc_id, ngram): topic TALKSABOUT concept, concept CONTAINS its parts."""
    n = F.size(F.split("ngram", " ")).cast("string")
    about = make_links(topics, F.concat(F.lit("topic/"), F.col("doc_id").cast("string")), F.lit("TALKSABOUT"), F.concat(F.lit("ngram"), n, F.lit("/"), F.col("ngram")), F.col("intent"), keyed=False)
    parts = sub_ngrams(topics.select("ngram").distinct())
    inner = make_links(parts, F.concat(F.lit("ngram"), F.size(F.split("phrase", " ")).cast("string"), F.lit("/"), F.col("phrase")), F.lit("CONTAINS"), F.concat(F.lit("ngram"), F.col("n").cast("string"), F.lit("/"), F.col("part")), F.lit(1.0), keyed=False)
    return about.union(inner)
