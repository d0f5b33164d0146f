"""Queries over web pages (parsed in Python: no SQL), samplers and links between tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.sources import html
from tessera.runtime import table


def clean_html(spark, sf_dir):
    return html.page_text(table(spark, sf_dir, "pages")).select("page_id", "text", "scripts")


def article_text(spark, sf_dir):
    return html.page_text(table(spark, sf_dir, "pages"), start="article", full=True).select("page_id", "text", "issues")


def history_rows(spark, sf_dir):
    """Edit histories made of events, a page for each user, read back as rows."""
    line = F.concat(
        F.lit('<li><a href="/w?diff=prev&x='), F.col("event_id").cast("string"), F.lit('">prev</a><a class="mw-changeslist-date">'), F.date_format("ts", "HH:mm, d MMMM yyyy"), F.lit('</a><a class="mw-userlink">user'),
        F.col("user_id").cast("string"), F.lit('</a><span>1,234 bytes</span><span>+'), F.floor("value").cast("string"), F.lit("</span><i>"), F.when(F.col("event_type") == "error", "Reverted edit").otherwise(F.col("event_type")), F.lit("</i><a>undo</a></li>"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"])
    pages = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page_id")).agg(F.concat(F.lit("<body>"), F.array_join(listed, ""), F.lit("</body>")).alias("html"))
    return html.history_rows(pages).select("page_id", F.col("at").cast("long").alias("at"), F.col("date").cast("string").alias("date"), "user", F.col("edit_delta").cast("long").alias("edit_delta"), F.trim("message").alias("message"), F.col("revert").cast("long").alias("revert"))


def random_accept(spark, sf_dir):
    """Four requests of five are accepted, by a hash of their id."""
    e = table(spark, sf_dir, "events")
    return e.filter(F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long") < int(0.8 * 2**32)).select("event_id")


QUERIES = {f.__name__: f for f in (clean_html, article_text, history_rows, random_accept)}
ORACLES = {
    "history_rows": """SELECT user_id AS page_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS at, strftime(ts, '%Y-%m-%d %H:%M:00') AS date, 'user' || user_id AS "user", CAST(floor(value) AS BIGINT) AS edit_delta,
CASE WHEN event_type = 'error' THEN 'Reverted edit' ELSE event_type END || '.' AS message, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::BIGINT AS revert FROM events""",
    "random_accept": "SELECT event_id FROM events WHERE ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT < 3435973836",
}
