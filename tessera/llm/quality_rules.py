"""Host-level quality rules (DataFrame functions only).

Rules judge each document; failures are counted per host; each host's failure rate is shrunk towards the
mean of all hosts with a beta prior fitted by moments; hosts whose shrunk rate is above a threshold are
rejected, and the verdict is joined back to their documents.

Repeated 5-word windows are found inside the row: window hashes (64 bits) are sorted with their positions,
and positions whose hash equals a neighbour's are covered. No window leaves its document, so nothing is
shuffled but one small row per host; a host with a third of all rows is pre-aggregated like any other.

Defined results: a null text has no words and fails; a null host is a host of its own; without documents
the result is empty; equal rows are judged alike. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import let, packed, space_words, unpacked
from tessera.runtime import materialize, small, table

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_HOST_RATE = 0.5
SYMBOLS = r"[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words within windows that occur twice or more, the first occurrence included (long)."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(*[F.get(words, i + k - 1) for k in range(window)]))
    return F.when(n >= window, let(hashes, lambda h: _covered(h, window))).otherwise(0).cast("long")


def _covered(hashes: Column, window: int) -> Column:
    """Words covered by the windows whose hash is not alone, in sorted order of position."""
    spots = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = let(
        spots,
        lambda s: F.array_sort(
            F.transform(
                F.filter(
                    F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), ((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])).alias("twice"))),
                    lambda x: x["twice"],
                ),
                lambda x: x["i"],
            )
        ),
    )
    total = let(again, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(0).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measures that rules use, each named qr_..., and qr_base_failed; columns by these names give way."""
    names = ("qr_n_words", "qr_word_chars", "qr_n_symbols", "qr_n_dup_lines", "qr_n_repeat_words", "qr_base_failed")
    content = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(HAS_WORD))
    by_words = let(
        space_words(content),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("again")),
    )
    rows = packed(docs, "qr_row", text).withColumn("qr_words", by_words)
    frame = rows.select(
        *unpacked("qr_row", docs.columns, *names),
        F.col("qr_words.n").alias("qr_n_words"),
        F.col("qr_words.chars").alias("qr_word_chars"),
        F.regexp_count(content, F.lit(SYMBOLS)).cast("long").alias("qr_n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("qr_n_dup_lines"),
        F.col("qr_words.again").alias("qr_n_repeat_words"),
    )
    return frame.withColumn(
        "qr_base_failed",
        (F.col("qr_n_words") < MIN_WORDS) | (100 * F.col("qr_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("qr_n_words")),
    )


def host_verdicts(judged: DataFrame, host: str = "source", failed: str = "qr_base_failed", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """qr_host, qr_host_docs, qr_host_failures, qr_host_rate (shrunk), qr_host_ok: one row per host.

    The prior has the mean m and the variance v of the hosts' rates: strength m(1-m)/v - 1, kept within
    1 and 1e6; hosts of one and the same rate have the strongest prior.
    """
    hosts = materialize(
        judged.groupBy(F.col(host).alias("qr_host")).agg(F.count(F.lit(1)).alias("qr_host_docs"), F.sum(F.col(failed).cast("long")).alias("qr_host_failures")), "hosts"
    )
    rate = F.col("qr_host_failures") / F.col("qr_host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()  # one row
    mean, spread = prior["m"] or 0.0, prior["v"] or 0.0
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    shrunk = (F.col("qr_host_failures") + mean * strength) / (F.col("qr_host_docs") + strength)
    return hosts.withColumn("qr_host_rate", shrunk).withColumn("qr_host_ok", F.col("qr_host_rate") <= max_rate)


def with_verdicts(judged: DataFrame, host: str = "source", **options) -> DataFrame:
    """`judged` with qr_host_rate and qr_kept; columns by these names give way."""
    verdicts = small(host_verdicts(judged, host, **options).select("qr_host", "qr_host_rate", "qr_host_ok"))
    rows = packed(judged, "qr_row", host)
    joined = rows.join(verdicts, rows[host].eqNullSafe(verdicts["qr_host"]), "left")
    kept = ~F.col("qr_row.qr_base_failed") & F.col("qr_host_ok")
    return joined.select(*unpacked("qr_row", judged.columns, "qr_host_rate", "qr_kept"), "qr_host_rate", kept.alias("qr_kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", **options) -> DataFrame:
    """The documents that pass, with their own columns. Measures are computed once for hosts, once to filter."""
    rows = packed(docs, "qr_row", text, host)
    return with_verdicts(measures(rows, text), host, **options).filter("qr_kept").select("qr_row.*")


def op5_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    judged = with_verdicts(materialize(measures(docs).drop("text"), "measures"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"qr_{x}").alias(x) for x in names], F.round("qr_host_rate", 6).alias("host_rate"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents
), x AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), l AS (
  SELECT r, i, word AS w0, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3, lead(word, 4) OVER o AS w4 FROM x WINDOW o AS (PARTITION BY r ORDER BY i)
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w0, w1, w2, w3, w4) AS c FROM l WHERE w4 IS NOT NULL
), p AS (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM g WHERE c > 1
), rep AS (
  SELECT r, sum(least(5, coalesce(j - i, 5))) AS n FROM p GROUP BY r
), m AS (
  SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
       - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, sum(base_failed::BIGINT)::DOUBLE AS f FROM f GROUP BY source
), pr AS (
  SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h
), st AS (
  SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM pr
), v AS (
  SELECT source, (f + m * s) / (n + s) AS host_rate FROM h, st
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= 0.5 AS kept, round(host_rate, 6) AS host_rate
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
