"""Streaming queries: events replayed from their file. A last event an hour after all others moves the watermark past them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import history_queries as HQ
from tessera.plans import promise_queries as PQ
from tessera.runtime import scratch, table
from tessera.streaming import online as S


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = scratch(spark, "replay")
    e.repartitionByRange(4, "ts").write.parquet(f"{path}")
    return S.replay(spark, path, e.schema)


def _closed(spark, sf_dir):
    """The same, with an event of no key at the end."""
    e = table(spark, sf_dir, "events")
    path = scratch(spark, "replay")
    e.repartitionByRange(4, "ts").write.parquet(path)
    end = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit('{"k": 0}').alias("props"))
    end.select(*e.columns).coalesce(1).write.mode("append").parquet(path)
    return S.replay(spark, path, e.schema, per_trigger=1000)


def stream_weekly_sum(spark, sf_dir):
    return S.run_all(S.weekly_sums(_events(spark, sf_dir)), "complete").select("slot", F.round(F.col("v") + 1e-9, 6).alias("v"))


def stream_rate_limiter(spark, sf_dir):
    return S.run_all(S.rate_limiter(_closed(spark, sf_dir), "event_type", 3600.0)).filter("id >= 0").select(F.col("key").alias("name"), F.col("id").alias("seq"), "ready")


def stream_promises(spark, sf_dir):
    found = S.run_all(S.promise_states(_closed(spark, sf_dir), "event_type")).filter("id >= 0")
    return found.select(F.col("key").alias("promise"), F.col("id").alias("seq"), "i", F.round("q_av", 6).alias("q_av"), F.round(F.col("q_var") + 1e-9, 6).alias("q_var"))


def stream_episodes(spark, sf_dir):
    stream = _closed(spark, sf_dir).withColumn("subject", (F.get_json_object("props", "$.k").cast("long") % HQ.SUBJECTS).cast("string"))
    found = S.run_all(S.episodes(stream, "subject", HQ.SCALE, HQ.DAYS["db"])).filter("id >= 0")
    return found.groupBy(F.col("key").cast("long").alias("subject"), "episode").agg(F.count(F.lit(1)).alias("edits"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


QUERIES = {f.__name__: f for f in (stream_weekly_sum, stream_rate_limiter, stream_promises, stream_episodes)}
ORACLES = {
    "stream_weekly_sum": PQ.ORACLES["weekly_sum"],
    "stream_rate_limiter": PQ.ORACLES["rate_limiter"],
    "stream_promises": f"WITH {PQ.STATES} SELECT promise, seq, i, round(q_av, 6) AS q_av, round(q_var + 1e-9, 6) AS q_var FROM d",
    "stream_episodes": f"WITH RECURSIVE {HQ._episodes('db')} SELECT subject, episode::BIGINT AS episode, count(*) AS edits, min(seq) AS first_id, max(seq) AS last_id FROM ep GROUP BY subject, episode",
}
