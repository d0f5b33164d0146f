"""Mixing sources to target weights (DataFrame functions only).

Words are counted per source, each source gets a target, and the repetition rate is target / size.
Every document is emitted floor(rate) times, and once more with a probability equal to the fraction,
drawn from a hash of the seed and its id: a rerun draws the same.

Targets fill like water: target = min(cap, level * weight), with the level at which the targets add up.
That is where resharing the excess of capped sources by weight ends, found in one pass over the sources
sorted by cap / weight. Only the table of sources is ordered as a whole; documents are never sorted.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a document
without an id draws by its text; equal rows draw alike; a source without words has target 0; an empty
table gives an empty result. Other columns of mixed documents pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import count_words, packed, unpacked
from tessera.runtime import materialize, small

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEAT = 2.0


def draw(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the seed and the document's id."""
    key = F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """mix_source, mix_source_size -> with mix_target. One row per source; nulls come last in order."""
    ordered = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())))
    weighed = ordered.select(
        "mix_source",
        "mix_source_size",
        "n",
        F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("mix_source_size").cast("double") * max_repeat).alias("cap"),
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    full = F.sum("mix_source_size").over(Window.partitionBy()).cast("double") * share
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    filled = weighed.select("*", full.alias("full"), before.alias("before"), after.alias("after")).withColumn(
        "capped", F.col("full") - F.col("before") >= F.col("cap") / F.col("weight") * F.col("after")
    )
    whole = Window.partitionBy()
    level = (F.col("full") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0.0))) / F.sum(
        F.when(~F.col("capped"), F.col("weight"))
    ).over(whole)
    return filled.select("mix_source", "mix_source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("mix_target"))


def plan_copies(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights=WEIGHTS,
    share: float = SHARE,
    max_repeat: float = MAX_REPEAT,
    seed: int = 0,
) -> DataFrame:
    """`docs` with mix_size, mix_source_size, mix_target and mix_copies, the times that each is emitted.

    Columns of `docs` by these four names give way to them.
    """
    sizes = docs.groupBy(F.col(source).alias("mix_source")).agg(F.sum(count_words(F.col(text))).alias("mix_source_size"))
    per_source = small(materialize(targets(sizes, weights, share, max_repeat), "targets"))
    rows = packed(docs, "mix_row", doc_id, text, source)
    joined = rows.join(per_source, rows[source].eqNullSafe(per_source["mix_source"]))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    extra = draw(rows[doc_id], rows[text], seed) < rate - F.floor(rate)
    made = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
    return joined.select(*unpacked("mix_row", docs.columns, *made), count_words(rows[text]).alias(made[0]), *made[1:3], (F.floor(rate) + extra.cast("long")).alias(made[3]))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of `docs`, each row as often as planned."""
    names = [options.get(k, k) for k in ("doc_id", "text", "source")]
    planned = plan_copies(packed(docs, "mix_row", *names), **options).filter("mix_copies > 0")
    return planned.select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("mix_row.*")


def op10_mixing(spark, sf_dir):
    from tessera.runtime import table

    planned = plan_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size::DOUBLE * 2.0 AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS whole FROM s
), f AS (
  SELECT *, whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            >= cap / weight * sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM w
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE
    (whole - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN weight END) OVER () * weight END AS target FROM f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('0:' || coalesce(CAST(d.doc_id AS VARCHAR), md5(d.text), '')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
