"""Queries over promises, rate limits and weekly periodograms of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.times import torus_label, torus_slot
from tessera.operators import promises as P
from tessera.runtime import table

BOUND, INTERVAL = 60.0, 3600e9  # values of about 20, hours between samples


def _samples(spark, sf_dir):
    return P.samples(table(spark, sf_dir, "events"))


def _states(spark, sf_dir):
    return P.learned(_samples(spark, sf_dir))


def promise_history(spark, sf_dir):
    found = P.last_state(_states(spark, sf_dir))
    return found.select("promise", "t", "t1", "t2", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("q", "q1", "q2", "q_av", "q_var")], F.round(F.col("dt_av") / 1e9, 3).alias("dt_av_s"), F.round(F.sqrt("dt_var") / 1e9, 3).alias("dt_sd_s"))


def derivatives(spark, sf_dir):
    states = _states(spark, sf_dir)
    return states.select("seq", F.round(P.first_derivative(BOUND, INTERVAL), 5).alias("d1"), F.round(P.second_derivative(BOUND, INTERVAL), 5).alias("d2"))


def trust_score(spark, sf_dir):
    scored = P.outcomes(_states(spark, sf_dir), BOUND, INTERVAL, quality=F.lit(0.5))
    return P.trust(scored).select("promise", "samples", F.round("reliability", 8).alias("reliability"))


def stamped_latency(spark, sf_dir):
    s = _samples(spark, sf_dir).select(F.col("promise").alias("name"), F.col("seq"), F.col("t").alias("before"), (F.col("t") + (F.col("q") * 1000).cast("long") * 1000).alias("after"))
    return P.latencies(s).select("seq", "key", "latency", "change", F.round("rate", 6).alias("rate"))


def rate_limiter(spark, sf_dir):
    r = _samples(spark, sf_dir).select(F.col("promise").alias("name"), "seq", F.col("t").alias("begin_ns"), (F.col("t") + 10**9).alias("end_ns"))
    return P.rate_limited(r, 3600.0).select("name", "seq", "ready")


def torus_slots(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", torus_slot(F.col("ts")).alias("slot"), torus_label(F.col("ts")).alias("label"))


def _slots(f):
    def query(spark, sf_dir):
        e = table(spark, sf_dir, "events")
        found = f(e, "ts", "value") if f is P.weekly_sum else f(e, "ts", "value", "event_id")
        return found.select("slot", F.round(F.col("v") + 1e-9, 6).alias("v"))

    return query


def weekly_dense(spark, sf_dir):
    found = P.weekly_dense(P.weekly_sum(table(spark, sf_dir, "events"), "ts", "value"))
    return found.select("idx", "slot", F.round(F.col("v") + 1e-9, 6).alias("v"))


def weekly_smooth(spark, sf_dir):
    found = P.weekly_smooth(P.weekly_dense(P.weekly_sum(table(spark, sf_dir, "events"), "ts", "value")))
    return found.select("idx", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def weekly_smooth_series(spark, sf_dir):
    """Three series of a week side by side: sums, what is learned, and the last values."""
    e = table(spark, sf_dir, "events")
    found = {"sum": P.weekly_sum(e, "ts", "value"), "learn": P.weekly_learn(e, "ts", "value", "event_id"), "set": P.weekly_set(e, "ts", "value", "event_id")}
    dense = reduce(DataFrame.unionByName, [P.weekly_dense(f).withColumn("series", F.lit(k)) for k, f in found.items()])
    return P.weekly_smooth(dense, "series").select("series", "idx", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


QUERIES = {"weekly_sum": _slots(P.weekly_sum), "weekly_learn": _slots(P.weekly_learn), "weekly_set": _slots(P.weekly_set)} | {
    f.__name__: f for f in (promise_history, derivatives, trust_score, stamped_latency, rate_limiter, torus_slots, weekly_dense, weekly_smooth, weekly_smooth_series)
}


def _slot(ts: str) -> str:
    m = f"(minute({ts}) // 5) * 5"
    return f"strftime({ts}, '%a:Hr%H:Min') || lpad(CAST({m} AS VARCHAR), 2, '0') || '_' || lpad(CAST(({m} + 5) % 60 AS VARCHAR), 2, '0')"


def limits(end: str, expire_s: int) -> str:
    """Requests an hour apart, one after another; what still runs keeps nobody out, and only what has ended counts."""
    return f"""WITH RECURSIVE s AS (SELECT event_type AS name, event_id AS seq, epoch_us(ts) * 1000 AS t, {end} AS e, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT name, seq, i, NULL::BIGINT AS last, t AS lock, CASE WHEN e IS NULL THEN []::BIGINT[] ELSE [e] END AS running, true AS ready, false AS expired FROM s WHERE i = 1
UNION ALL SELECT name, seq, i, last, CASE WHEN ready THEN t ELSE lock END, CASE WHEN ready AND e IS NOT NULL THEN list_append(running, e) ELSE running END, ready, ready AND lock IS NOT NULL AND t - lock > {expire_s}000000000
  FROM (SELECT *, last IS NULL OR t - last >= 3600000000000 AS ready FROM (SELECT s.name, s.seq, s.i, s.t, s.e, coalesce(list_max(list_filter(r.running, lambda x: x <= s.t)), r.last) AS last,
    CASE WHEN len(list_filter(r.running, lambda x: x <= s.t)) > 0 THEN NULL ELSE r.lock END AS lock, list_filter(r.running, lambda x: x > s.t) AS running FROM r JOIN s ON s.name = r.name AND s.i = r.i + 1)))"""


STATES = """s AS (SELECT event_type AS promise, event_id AS seq, epoch_us(ts) * 1000 AS t, value AS raw, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
a AS (SELECT *, CASE WHEN i = 1 THEN 0.0::DOUBLE ELSE raw END AS q FROM s),
b AS (SELECT *, coalesce(lag(q, 1) OVER o, 0) AS q1, coalesce(lag(q, 2) OVER o, 0) AS q2, coalesce(lag(t, 1) OVER o, 0) AS t1, coalesce(lag(t, 2) OVER o, 0) AS t2 FROM a WINDOW o AS (PARTITION BY promise ORDER BY i)),
c AS (SELECT *, CASE WHEN i > 1 THEN (t - t1)::DOUBLE END AS dt, CASE WHEN i > 1 THEN 0.5::DOUBLE * q1 + 0.5::DOUBLE * q ELSE 0.6::DOUBLE * raw END AS q_av FROM b),
d AS (SELECT *, CASE WHEN i > 1 THEN 0.5::DOUBLE * (q - q_av) * (q - q_av) ELSE 0 END AS q_var FROM c)"""
_D1 = f"coalesce(((q - q1) / {BOUND}::DOUBLE) / nullif((t - t1) / {INTERVAL}::DOUBLE, 0), 0)"
_D2 = f"coalesce((((q - q1) / nullif((t - t1)::DOUBLE, 0) - (q1 - q2) / nullif((t1 - t2)::DOUBLE, 0)) / {BOUND}::DOUBLE * {INTERVAL}::DOUBLE) / nullif(q1 * (t - t1) / {INTERVAL}::DOUBLE, 0), 0)"
_SUM = f"w AS (SELECT {_slot('ts')} AS slot, sum(value) AS v FROM events GROUP BY 1)"
_GRID = f"g AS (SELECT CAST(i AS INT) AS idx, {_slot('(make_timestamp((345200 + i * 300) * 1000000))')} AS slot FROM range(2016) r(i))"
ORACLES = {
    "promise_history": f"""WITH {STATES}, e AS (SELECT promise, list_reduce(list_prepend(0.0::DOUBLE, list(dt ORDER BY i) FILTER (dt IS NOT NULL)), lambda x, y: 0.5::DOUBLE * x + 0.5::DOUBLE * y) AS dt_av FROM d GROUP BY promise)
SELECT promise, t, t1, t2, round(q + 1e-9, 6) AS q, round(q1 + 1e-9, 6) AS q1, round(q2 + 1e-9, 6) AS q2, round(q_av + 1e-9, 6) AS q_av, round(q_var + 1e-9, 6) AS q_var, round(dt_av / 1e9, 3) AS dt_av_s, round(sqrt(0.5::DOUBLE * q_var + 0.5::DOUBLE * (dt_av - dt) * (dt_av - dt)) / 1e9, 3) AS dt_sd_s
FROM d JOIN e USING (promise) QUALIFY row_number() OVER (PARTITION BY promise ORDER BY i DESC) = 1""",
    "derivatives": f"WITH {STATES} SELECT seq, round({_D1}, 5) AS d1, round({_D2}, 5) AS d2 FROM d",
    "trust_score": f"""WITH {STATES}, x AS (SELECT *, 0.5::DOUBLE / (1 + exp(3 * (q - {BOUND}::DOUBLE) / {BOUND}::DOUBLE)) / CASE WHEN abs(q_av) < sqrt(q_var) THEN 1.5::DOUBLE ELSE 1 END AS d0, {_D1} AS d1, {_D2} AS d2 FROM d),
y AS (SELECT *, greatest(d0 + CASE WHEN d1 < -0.01 THEN 0.1::DOUBLE WHEN d1 > 0.01 THEN -0.1 ELSE 0 END + CASE WHEN d2 < -0.01 THEN 0.1::DOUBLE WHEN d2 > 0.01 THEN -0.1 ELSE 0 END, 0) AS delta FROM x)
SELECT promise, count(*) AS samples, round(list_reduce(list_prepend(0.0::DOUBLE, list(delta ORDER BY i)), lambda r, z: 0.4::DOUBLE * CASE WHEN r = 0 THEN 0.5 ELSE r END + 0.6::DOUBLE * z), 8) AS reliability FROM y GROUP BY promise""",
    "stamped_latency": f"""WITH s AS (SELECT event_type AS name, event_id AS seq, epoch_us(ts) * 1000 AS before, epoch_us(ts) * 1000 + CAST(trunc(value * 1000) AS BIGINT) * 1000 AS after FROM events),
k AS (SELECT *, name || ':' || {_slot('(make_timestamp(after // 1000))')} AS key, after - before AS latency FROM s),
l AS (SELECT *, latency - lag(latency, 1, 0) OVER (PARTITION BY key ORDER BY before, after) AS change FROM k) SELECT seq, key, latency, change, round(coalesce(change::DOUBLE / nullif(latency, 0), 0), 6) AS rate FROM l""",
    "rate_limiter": f"{limits('epoch_us(ts) * 1000 + 1000000000', 60)} SELECT name, seq, ready FROM r",
    "torus_slots": f"""SELECT event_id, {_slot('ts')} AS slot, CASE hour(ts) // 6 WHEN 0 THEN 'Night' WHEN 1 THEN 'Morning' WHEN 2 THEN 'Afternoon' ELSE 'Evening' END || ',' || dayname(ts) || ',Day' || day(ts) || ',' || monthname(ts) || ',Yr' || year(ts) || strftime(ts, ' at Hr%H Min%M Q') || (minute(ts) // 15 + 1)
 || ' Min' || lpad(CAST((minute(ts) // 5) * 5 AS VARCHAR), 2, '0') || '_' || lpad(CAST(((minute(ts) // 5) * 5 + 5) % 60 AS VARCHAR), 2, '0') AS label FROM events""",
    "weekly_sum": f"WITH {_SUM} SELECT slot, round(v + 1e-9, 6) AS v FROM w",
    "weekly_learn": f"SELECT {_slot('ts')} AS slot, round(list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda a, x: 0.5::DOUBLE * x + 0.5::DOUBLE * a) + 1e-9, 6) AS v FROM events GROUP BY 1",
    "weekly_set": f"SELECT slot, round(v + 1e-9, 6) AS v FROM (SELECT {_slot('ts')} AS slot, last(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1)",
    "weekly_dense": f"WITH {_SUM}, {_GRID} SELECT idx, slot, round(coalesce(v, 0) + 1e-9, 6) AS v FROM g LEFT JOIN w USING (slot)",
    "weekly_smooth": f"""WITH RECURSIVE {_SUM}, {_GRID}, x AS (SELECT idx, coalesce(v, 0)::DOUBLE AS v FROM g LEFT JOIN w USING (slot)),
r AS (SELECT idx, 0.7::DOUBLE * v AS mean, 0.7::DOUBLE * (v - 0.7::DOUBLE * v) * (v - 0.7::DOUBLE * v) AS var FROM x WHERE idx = 0
UNION ALL SELECT x.idx, 0.7::DOUBLE * v + 0.3::DOUBLE * mean, 0.7::DOUBLE * (v - (0.7::DOUBLE * v + 0.3::DOUBLE * mean)) * (v - (0.7::DOUBLE * v + 0.3::DOUBLE * mean)) + 0.3::DOUBLE * var FROM r JOIN x ON x.idx = r.idx + 1)
SELECT idx, round(mean, 6) AS mean, round(sqrt(var), 6) AS sd FROM r""",
    "weekly_smooth_series": f"""WITH RECURSIVE {_GRID}, w AS (SELECT 'sum' AS series, {_slot('ts')} AS slot, sum(value) AS v FROM events GROUP BY 2
UNION ALL SELECT 'learn', {_slot('ts')}, list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda a, x: 0.5::DOUBLE * x + 0.5::DOUBLE * a) FROM events GROUP BY 2 UNION ALL SELECT 'set', {_slot('ts')}, last(value ORDER BY ts, event_id) FROM events GROUP BY 2),
x AS (SELECT n.series, idx, coalesce(v, 0)::DOUBLE AS v FROM g CROSS JOIN (SELECT unnest(['sum', 'learn', 'set']) AS series) n LEFT JOIN w ON w.series = n.series AND w.slot = g.slot),
r AS (SELECT series, idx, 0.7::DOUBLE * v AS mean, 0.7::DOUBLE * (v - 0.7::DOUBLE * v) * (v - 0.7::DOUBLE * v) AS var FROM x WHERE idx = 0
UNION ALL SELECT x.series, x.idx, 0.7::DOUBLE * v + 0.3::DOUBLE * mean, 0.7::DOUBLE * (v - (0.7::DOUBLE * v + 0.3::DOUBLE * mean)) * (v - (0.7::DOUBLE * v + 0.3::DOUBLE * mean)) + 0.3::DOUBLE * var FROM r JOIN x ON x.series = r.series AND x.idx = r.idx + 1)
SELECT series, idx, round(mean, 6) AS mean, round(sqrt(var), 6) AS sd FROM r""",
}
