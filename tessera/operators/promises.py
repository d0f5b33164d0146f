"""Promises: what is learned from a series of measured times, and week-long periodograms.

Samples have promise, seq (order: by t, ties by id), t (ns), q. Everything but two running averages comes from
lags; those two are folds over a promise's own samples. A null promise is one of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.times import torus_slot, week_slots
from tessera.operators.history import ns, running_average
from tessera.runtime import fold_rows


def samples(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("promise"), F.col("event_id").alias("seq"), F.col("ts"), ns(F.col("ts")).alias("t"), F.col("value").alias("q"))


#: An average that halves its past with each sample rests on its last 64 samples.
MEMORY = 64


def learned(frame: DataFrame) -> DataFrame:
    """The state after each sample: i, q, q1, q2, q_av, q_var, t, t1, t2, dt_av, dt_var.

    The first sample is stored as q = 0 with q_av = 0.6 q; later averages rest on the raw value before.
    """
    w = Window.partitionBy("promise").orderBy("t", "seq")
    i = F.row_number().over(w)
    numbered = frame.withColumn("i", i).withColumn("raw", F.col("q")).withColumn("q", F.when(F.col("i") == 1, F.lit(0.0)).otherwise(F.col("raw")))
    lagged = numbered
    for name, k in (("q1", 1), ("q2", 2)):
        lagged = lagged.withColumn(name, F.coalesce(F.lag("q", k).over(w), F.lit(0.0)))
    for name, k in (("t1", 1), ("t2", 2)):
        lagged = lagged.withColumn(name, F.coalesce(F.lag("t", k).over(w), F.lit(0).cast("long")))
    late = F.col("i") > 1
    dt = F.when(late, (F.col("t") - F.col("t1")).cast("double"))
    made = lagged.withColumn("dt", dt).withColumn("q_av", F.when(late, 0.5 * F.col("q1") + 0.5 * F.col("q")).otherwise(0.6 * F.col("raw")))
    made = made.withColumn("q_var", F.when(late, 0.5 * (F.col("q") - F.col("q_av")) * (F.col("q") - F.col("q_av"))).otherwise(0.0))
    recent = F.collect_list("dt").over(w.rowsBetween(-(MEMORY - 1), 0))
    made = made.withColumn("dt_av", F.aggregate(recent, F.lit(0.0), lambda a, x: 0.5 * a + 0.5 * x))
    gap = F.col("dt_av") - F.col("dt")
    return made.withColumn("dt_var", F.when(late, 0.5 * F.col("q_var") + 0.5 * gap * gap).otherwise(0.0)).drop("raw")


def last_state(states: DataFrame) -> DataFrame:
    """One row for each promise: its last state."""
    keep = [c for c in states.columns if c not in ("promise", "i", "ts", "seq")]
    return states.groupBy("promise").agg(F.max_by(F.struct(*keep), "i").alias("s")).select("promise", "s.*")


def first_derivative(q_scale: float, t_scale: float) -> Column:
    return F.coalesce(F.try_divide((F.col("q") - F.col("q1")) / q_scale, (F.col("t") - F.col("t1")) / F.lit(float(t_scale))), F.lit(0.0))


def second_derivative(q_scale: float, t_scale: float) -> Column:
    """Change of slope by the change expected; 0 where that is 0 or a slope is undefined."""
    slope = F.try_divide(F.col("q") - F.col("q1"), (F.col("t") - F.col("t1")).cast("double"))
    before = F.try_divide(F.col("q1") - F.col("q2"), (F.col("t1") - F.col("t2")).cast("double"))
    expected = F.col("q1") * (F.col("t") - F.col("t1")) / F.lit(float(t_scale))
    return F.coalesce(F.try_divide((slope - before) / q_scale * t_scale, expected), F.lit(0.0))


def outcomes(states: DataFrame, bound: float, interval: float, quality: Column | float = 1.0, nano: float = 1.0) -> DataFrame:
    """`states` with delta: how well the promise was kept by this sample, from 0."""
    promised, trusted = bound * nano, interval * nano
    level = 1 / (1 + F.exp(3 * (F.col("q") - promised) / promised))
    delta = level * quality
    delta = F.when(F.abs("q_av") < F.sqrt("q_var"), delta / 1.5).otherwise(delta)
    for slope in (first_derivative(promised, trusted), second_derivative(promised, trusted)):
        delta = delta + F.when(slope < -0.01, 0.1).when(slope > 0.01, -0.1).otherwise(0.0)
    return states.withColumn("delta", F.greatest(delta, F.lit(0.0)))


def trust(scored: DataFrame) -> DataFrame:
    """promise, samples, reliability: 0.4 of what it was and 0.6 of each delta, from 0.5; what fell to 0 starts there again."""

    def step(r, delta):
        r = 0.4 * (r or 0.5) + 0.6 * (delta or 0.0)
        return r, (r,)

    each = fold_rows(scored.select("promise", "i", "delta"), ["promise"], ["i", "delta"], ["delta"], 0.0, step, "reliability double")
    return each.groupBy("promise").agg(F.count(F.lit(1)).alias("samples"), F.max_by("reliability", F.struct("i", "delta")).alias("reliability"))


def latencies(begins: DataFrame) -> DataFrame:
    """begins (name, before, after: ns) -> with key (name:slot), latency, its change, and its rate against the last of the key."""
    stamp = F.timestamp_micros((F.col("after") / 1000).cast("long"))
    key = F.when(F.coalesce(F.col("name"), F.lit("")) == "", torus_slot(stamp)).otherwise(F.concat("name", F.lit(":"), torus_slot(stamp)))
    w = Window.partitionBy("key").orderBy("before", "after")
    made = begins.withColumn("key", key).withColumn("latency", F.col("after") - F.col("before"))
    made = made.withColumn("change", F.col("latency") - F.lag("latency", 1, 0).over(w)).withColumn("since", F.col("after") - F.lag("after").over(w))
    return made.withColumn("rate", F.coalesce(F.try_divide(F.col("change").cast("double"), F.col("latency").cast("double")), F.lit(0.0)))


def rate_limited(requests: DataFrame, apart_s: float = 30.0, expire_s: float = 60.0) -> DataFrame:
    """requests (name, seq, begin_ns, end_ns) -> with ready: no request of the name was completed within the time before,
    and expired: a request that was let in still ran (one without an end always does) after more than expire_s, so that
    its lock was taken from it. One that runs keeps no other out.

    Only requests that were let in count, so it is a fold over each name's requests in order; its state is the time of the
    last completion, the lock and the ends still to come. A null name is a name; requests without a begin are not ready.
    """
    apart, expire = int(apart_s * 1e9), int(expire_s * 1e9)

    def step(state, begin, end):
        last, lock, running = state
        if begin is None:
            return state, (False, False)
        done = [e for e in running if e <= begin]
        if done:
            last, lock, running = max(done), None, tuple(e for e in running if e > begin)
        ready = last is None or begin - last >= apart
        expired = ready and lock is not None and begin - lock > expire
        if ready:
            lock, running = begin, running if end is None else (*running, end)
        return (last, lock, running), (ready, expired)

    return fold_rows(requests, ["name"], ["begin_ns", "seq"], ["begin_ns", "end_ns"], (None, None, ()), step, "ready boolean, expired boolean")


# ---- periodograms


def weekly_sum(frame: DataFrame, ts: str, value: str, *keys: str) -> DataFrame:
    return frame.groupBy(*keys, torus_slot(F.col(ts)).alias("slot")).agg(F.sum(value).alias("v"))


def weekly_learn(frame: DataFrame, ts: str, value: str, order: str) -> DataFrame:
    """slot, v: half of each value and half of what was, from 0, in order; each slot of each week is a block."""
    rows = frame.select(torus_slot(F.col(ts)).alias("slot"), F.col(ts).alias("t"), F.col(order).alias("o"), F.col(value).alias("x"))
    block = F.floor(ns(F.col("t")) / (300 * 10**9))
    return running_average(rows, ["slot"], ["t", "o", "x"], block, "x", 0.0, 0.5, 0.5).select("slot", F.col("average").alias("v"))


def weekly_set(frame: DataFrame, ts: str, value: str, order: str) -> DataFrame:
    """slot, v: the last value."""
    return frame.groupBy(torus_slot(F.col(ts)).alias("slot")).agg(F.max_by(value, F.struct(ts, order)).alias("v"))


def weekly_dense(slots: DataFrame) -> DataFrame:
    """idx, slot, v: all 2016 slots in order, 0 where nothing is known."""
    return week_slots(slots.sparkSession).join(slots, "slot", "left").select("idx", "slot", F.coalesce("v", F.lit(0.0)).alias("v"))


def weekly_smooth(dense: DataFrame, *keys: str) -> DataFrame:
    """keys, idx, mean, sd: running over the week; 2016 rows for each series."""

    def step(a, x):
        mean = 0.7 * x["v"] + 0.3 * a["mean"]
        var = 0.7 * (x["v"] - mean) * (x["v"] - mean) + 0.3 * a["var"]
        return F.named_struct(F.lit("mean"), mean, F.lit("var"), var, F.lit("out"), F.concat(a["out"], F.array(F.named_struct(F.lit("idx"), x["idx"], F.lit("mean"), mean, F.lit("sd"), F.sqrt(var)))))

    zero = F.named_struct(F.lit("mean"), F.lit(0.0), F.lit("var"), F.lit(0.0), F.lit("out"), F.array().cast("array<struct<idx:int,mean:double,sd:double>>"))
    listed = dense.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("list"))
    return listed.select(*keys, F.explode(F.aggregate("list", zero, step)["out"]).alias("r")).select(*keys, "r.idx", "r.mean", "r.sd")
