"""The online forms of learning, rate limits, episodes and periodograms, on Structured Streaming.

Events may come out of order up to a delay. Each key's rows wait in its state until the watermark has passed them,
then go through a step function in order of (time, id): a replay gives what the batch operators give. State is the
step's own few numbers and the rows still waiting, as packed arrays; a task holds arrays of a key's rows, not rows. Rows later than the watermark when a stream stops stay waiting;
an episode that no later event closes stays open.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.times import torus_slot
from tessera.operators.history import DAY_NS, MINUTE_NS
from tessera.operators.running import pack, unpack
from tessera.runtime import scratch

DELAY = "10 minutes"
#: Rows that go through a step function before they are given out; the time, in ns, of a row without one.
SLICE, UNDATED = 20_000, -(1 << 63)


def _closed(column: np.ndarray) -> tuple[str, object]:
    """A column for the state: whole numbers as differences, since rows are in order."""
    if column.dtype == np.int64:
        return "int64", pack(np.diff(column, prepend=np.int64(0)))
    return ("float64", pack(np.ascontiguousarray(column).view(np.int64))) if column.dtype == np.float64 else ("", column)


def _opened(closed: tuple[str, object]) -> np.ndarray:
    kind, held = closed
    return np.cumsum(unpack(held)) if kind == "int64" else unpack(held).view(np.float64) if kind else held


def replay(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream of events: ts is a time with a zone."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def in_order(stream: DataFrame, key: str, columns: list[str], step: Callable, start, output: str, delay: str = DELAY) -> DataFrame:
    """step(state, row) -> (state, output row or None), for each key's rows (ts, id first of the columns) in order; ts comes in ns."""
    names = [x.split()[0] for x in output.split(", ")]

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, waiting = pickle.loads(state.get[0]) if state.exists else (start, None)
        parts = [] if waiting is None else [[_opened(w) for w in waiting]]
        del waiting
        for pdf in batches:
            parts.append([pdf[columns[0]].to_numpy("datetime64[ns]").view("int64"), *(pdf[c].to_numpy() for c in columns[1:])])
        held = []
        for k in range(len(columns)):
            held.append(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, "int64"))
            for p in parts:
                p[k] = None
        order = np.lexsort((held[1], held[0]))
        for k in range(len(columns)):
            held[k] = held[k][order]
        del order
        watermark = state.getCurrentWatermarkMs()
        undated = int(np.searchsorted(held[0], UNDATED, side="right"))  # these wait for ever
        over = max(undated, int(np.searchsorted(held[0], watermark * 10**6, side="right")))
        for at in range(undated, over, SLICE):
            out = []
            for row in zip(*[c[at : min(at + SLICE, over)].tolist() for c in held], strict=True):
                current, made = step(current, row)
                if made is not None:
                    out.append((group[0], *made))
            yield pd.DataFrame(out, columns=names)
        held = [np.concatenate([c[:undated], c[over:]]) if undated else c[over:] for c in held]
        state.update((pickle.dumps((current, [_closed(c) for c in held])),))
        if len(held[0]) > undated:
            state.setTimeoutTimestamp(max(int(held[0][undated] // 10**6), watermark + 1))
        if over == undated:
            yield pd.DataFrame([], columns=names)

    marked = stream.withWatermark("ts", delay).select(F.col(key).alias("key"), *columns)
    return marked.groupBy("key").applyInPandasWithState(run, output, "blob binary", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limiter(stream: DataFrame, key: str, apart_s: float, **options) -> DataFrame:
    """key, id, ready: whether nothing of the key was completed within the time before. A request that is let in takes a
    second, and keeps no other out meanwhile."""
    apart, takes = int(apart_s * 1e9), 10**9

    def step(state, row):
        last, running = state
        now = row[0]
        done = [e for e in running if e <= now]
        if done:
            last, running = max(done), tuple(e for e in running if e > now)
        ready = last is None or now - last >= apart
        return (last, (*running, now + takes) if ready else running), (row[1], ready)

    return in_order(stream, key, ["ts", "event_id"], step, (None, ()), "key string, id long, ready boolean", **options)


def promise_states(stream: DataFrame, key: str, value: str = "value", **options) -> DataFrame:
    """key, id, i, q_av, q_var, dt_av (ns): the state learned after each sample."""

    def step(s, row):
        t, q = row[0], row[2]
        if s is None:
            return (1, 0.0, t, 0.0), (row[1], 1, 0.6 * q, 0.0, 0.0)
        i, last, before, dt_av = s
        q_av, dt_av = 0.5 * last + 0.5 * q, 0.5 * dt_av + 0.5 * (t - before)
        return (i + 1, q, t, dt_av), (row[1], i + 1, q_av, 0.5 * (q - q_av) ** 2, dt_av)

    return in_order(stream, key, ["ts", "event_id", value], step, None, "key string, id long, i long, q_av double, q_var double, dt_av double", **options)


def episodes(stream: DataFrame, key: str, scale: float, days: float, **options) -> DataFrame:
    """key, id, episode: which episode each event belongs to (the kind "db" of the batch form)."""
    day = int(days * DAY_NS)

    def step(s, row):
        t = row[0]
        last, ema, burst, episode = s or (0, float(MINUTE_NS), None, 1)
        gap, burst = max(t - last, 0), t if burst is None else burst
        closes = gap > day and t - burst > day and gap > scale * ema
        return (t, 0.4 * ema + 0.6 * gap, None if closes else burst, episode + closes), (row[1], episode)

    return in_order(stream, key, ["ts", "event_id"], step, None, "key string, id long, episode long", **options)


def weekly_sums(stream: DataFrame, value: str = "value") -> DataFrame:
    """slot, v: a running sum for each of the 2016 slots."""
    return stream.groupBy(torus_slot(F.col("ts")).alias("slot")).agg(F.sum(value).alias("v"))


def run_all(frame: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table of the shared folder; with "complete", of the last state."""
    spark = frame.sparkSession
    target = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{'last' if mode == 'complete' else f'batch={number}'}")

    frame.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{target}/last" if mode == "complete" else target).select(*frame.columns)
