"""Benchmark decontamination (DataFrame functions only).

Benchmark items and documents are normalised to the same words. The distinct windows of the items (n words,
or the whole item where it has fewer) form a hash set that is broadcast; the windows of every document are
hashed in the row, exploded and probed in one pass without a shuffle, and each hit is verified against the
window's words, so an equal hash is not enough. Only hits, and one row for each document, are shuffled.

The hash set is broadcast in blocks of at most `block` windows: a larger benchmark takes more passes, not
more memory. Per document, hits are bounded by its own words.

Rows are told apart by id, text hash and text length, so documents that share an id (or have none) keep
their own results, and equal rows each get theirs. Defined results: a null or wordless text has no words
and no hit; items without words are skipped; a null item id counts as the empty string; an empty benchmark
hits nothing; an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import let, packed, plain_words
from tessera.runtime import materialize, table

N = 10
BLOCK = 2_000_000
KEY = ("dc_id", "dc_hash", "dc_bytes")


def windows_of(words: Column, n: int) -> Column:
    """Array of the hashes of each run of n words, in order; empty if there are fewer."""
    last = F.size(words) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """dc_h, dc_len, dc_window (words), dc_items (ids as strings): the distinct windows of the benchmark."""
    words = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), plain_words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    each = words.select("item", size.alias("dc_len"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("dc_window"))
    return each.groupBy("dc_len", "dc_window").agg(F.array_sort(F.collect_set("item")).alias("dc_items")).select(F.xxhash64("dc_window").alias("dc_h"), "dc_len", "dc_window", "dc_items")


def _key(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias("dc_id"), F.xxhash64(F.col(text)).alias("dc_hash"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("dc_bytes")]


def find_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, block: int = BLOCK) -> DataFrame:
    """A row for each row of `docs`: dc_id, dc_hash, dc_bytes, dc_n_words, dc_spans (start, end; words from 1,
    end exclusive, sorted and disjoint), dc_items (sorted ids of the items hit)."""
    spark = docs.sparkSession
    known = materialize(item_windows(items, item_id, item_text, n), "windows")
    lengths = sorted(r[0] for r in known.select("dc_len").distinct().collect())  # n values at most
    # One array for each row: an element that every row has, then the windows of each length in turn.
    in_row = let(
        plain_words(F.col(text)),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), w.alias("words"), F.concat(F.array(F.lit(0).cast("bigint")), *[windows_of(w, k) for k in lengths]).alias("all")),
    )
    rows = docs.select(*_key(docs, doc_id, text), in_row.alias("dc_row"))
    # No array is empty; explode would put a filter on its size, and the array's whole computation, below.
    probes = rows.select(*KEY, F.col("dc_row.n").alias("dc_n_words"), F.col("dc_row.words").alias("dc_words"), F.posexplode_outer("dc_row.all").alias("dc_at", "dc_probe"))
    before = {k: sum((F.greatest(F.col("dc_n_words") - (j - 1), F.lit(0)) for j in lengths if j < k), F.lit(0)) for k in lengths}
    start = F.lit(0)
    for k in lengths:
        start = F.when(F.col("dc_len") == k, F.col("dc_at") - before[k]).otherwise(start)
    here = spark.range(1).select(
        F.lit(0).cast("bigint").alias("dc_h"), F.lit(0).alias("dc_len"), F.array().cast("array<string>").alias("dc_window"), F.array().cast("array<string>").alias("dc_items")
    )
    blocks = max(1, -(-known.count() // block))
    found = None
    for b in range(blocks):
        some = known.filter(F.pmod("dc_h", F.lit(blocks)) == b) if blocks > 1 else known
        some = F.broadcast(some.union(here) if b == 0 else some)
        right = F.when(F.col("dc_len") == 0, F.col("dc_at") == 0).otherwise((F.col("dc_at") > 0) & (F.slice(F.col("dc_words"), F.greatest(start, F.lit(1)).cast("int"), F.greatest("dc_len", F.lit(1))) == F.col("dc_window")))
        hits = probes.join(some, (F.col("dc_probe") == some["dc_h"]) & right).select(*KEY, "dc_n_words", start.cast("int").alias("s"), "dc_len", "dc_items")
        found = hits if found is None else found.union(hits)
    per_row = found.groupBy(*KEY).agg(
        F.max("dc_n_words").alias("dc_n_words"),
        F.sum((F.col("dc_len") == 0).cast("int")).alias("times"),
        F.collect_set(F.when(F.col("dc_len") > 0, F.struct(F.col("s").alias("start"), (F.col("s") + F.col("dc_len")).alias("end")))).alias("spans"),
        F.collect_set(F.when(F.col("dc_len") > 0, F.col("dc_items"))).alias("sets"),
    )
    return per_row.select(
        *KEY,
        "dc_n_words",
        _disjoint(F.array_sort("spans")).alias("dc_spans"),
        F.array_sort(F.array_distinct(F.flatten("sets"))).alias("dc_items"),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("times"),
    ).drop("times")


def _disjoint(spans: Column) -> Column:
    """Sorted spans without overlap: each starts where those before it ended, empty ones go."""
    running = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["end"]).alias("end"),
            F.when(x["end"] > F.greatest(x["start"], a["end"]), F.concat(a["out"], F.array(F.named_struct(F.lit("start"), F.greatest(x["start"], a["end"]), F.lit("end"), x["end"])))).otherwise(a["out"]).alias("out"),
        ),
    )
    return running["out"]


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("long")


def remove_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without a hit, with their own columns."""
    bad = materialize(find_hits(docs, items, doc_id, text, **options).filter(F.size("dc_spans") > 0).select(*KEY).distinct(), "contaminated")
    same = [a.eqNullSafe(bad[b]) for a, b in zip((F.col(doc_id), F.xxhash64(F.col(text)), F.coalesce(F.octet_length(text), F.lit(-1))), KEY, strict=True)]
    return docs.join(bad, same[0] & same[1] & same[2], "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All documents, with the words hit cut out of their text; what separates words stays with the word after it."""
    bad = materialize(find_hits(docs, items, doc_id, text, **options).filter(F.size("dc_spans") > 0).select(*KEY, "dc_spans").dropDuplicates(list(KEY)), "spans")
    same = [a.eqNullSafe(bad[b]) for a, b in zip((F.col(doc_id), F.xxhash64(F.col(text)), F.coalesce(F.octet_length(text), F.lit(-1))), KEY, strict=True)]
    joined = packed(docs, "dc_row", doc_id, text).join(bad, same[0] & same[1] & same[2], "left")
    mark, word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    # Capitals are letters here: the text is not lowered, so that what stays is as it was.
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"({mark}*{word}+)"), F.lit(1))
    tail = F.regexp_extract(F.col(text), f"({mark}*)$", 1)
    left = F.filter(pieces, lambda x, i: ~F.exists("dc_spans", lambda s: (s["start"] <= i + 1) & (i + 1 < s["end"])))
    cleaned = F.when(F.col("dc_spans").isNull(), F.col(text)).otherwise(F.concat(F.array_join(left, ""), tail))
    return joined.select(*[cleaned.alias(c) if c == text else F.col(f"dc_row.`{c}`").alias(c) for c in docs.columns])


def op4_decontamination(spark, sf_dir):
    hits = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        F.col("dc_id").alias("doc_id"),
        F.col("dc_n_words").alias("n_words"),
        hit_words(F.col("dc_spans")).alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ","), 256).alias("items_sha256"),
        (F.size("dc_spans") > 0).alias("contaminated"),
    )


_LEADS = ", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(1, N))
_WINDOWS = " UNION ALL ".join(
    f"SELECT r, i, {k} AS n, concat_ws(' ', {', '.join(['word', *(f'w{j}' for j in range(1, k))])}) AS win FROM leads WHERE {f'w{k - 1} IS NOT NULL' if k > 1 else 'true'} AND {k} IN (SELECT n FROM ns)"
    for k in range(1, N + 1)
)
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item, w, least({N}, len(w)) AS n, unnest(range(1, len(w) - least({N}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), ns AS (
  SELECT DISTINCT n FROM bw
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), leads AS (
  SELECT r, i, word, {_LEADS} FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), dw AS (
  {_WINDOWS}
), h AS (
  SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), k AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN it USING (r)
"""
