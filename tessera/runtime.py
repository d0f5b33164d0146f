"""Places and helpers that every operator shares."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from weakref import WeakKeyDictionary

import pyarrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


ARROW_ROWS = 2000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none (tests, notebooks) is a local folder set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write `frame` as Parquet in the shared folder and read it back.

    It cuts the lineage: a lost executor costs the tasks it was running, never what is written. The shuffle files
    of the write go as soon as it ends; nothing reads them again.
    """
    spark = frame.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(frame.schema).parquet(path)
    _written[out] = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables that materialize wrote for `frames`: for steps whose successors are written themselves.

    Frames of another make are left alone. Nothing that is still to run may read a released table.
    """
    for frame in frames:
        path = _written.pop(frame, None)
        if path:
            jvm = frame.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def _trimmed(run: Callable) -> Callable:
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pyarrow.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # of the C library of Linux alone
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def map_arrow(frame: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """frame.mapInArrow, in batches of at most ARROW_ROWS rows: a worker and its JVM hold few texts at a time.

    The setting is the session's, as a plan is made only when it runs; a lower one stays. A worker gives its memory
    back at the end of a task, for it may idle beside others.
    """
    conf = frame.sparkSession.conf
    if int(conf.get(_ARROW_ROWS)) > ARROW_ROWS:
        conf.set(_ARROW_ROWS, str(ARROW_ROWS))
    return frame.mapInArrow(_trimmed(run), schema)


def fold_rows(frame: DataFrame, keys: list[str], order: list[str], values: list[str], start: tuple, step: Callable, added: str) -> DataFrame:
    """`frame` with the columns `added`: step(state, *values) -> (state, tuple) for each key's rows in order, from start.

    For folds that feed back, so that no window function gives them. A key's rows are dealt to one task and sorted, which
    spills; the task holds a state and a batch, never a key's rows. A null key is a key of its own.
    """
    spark = frame.sparkSession
    more = spark.createDataFrame([], added).schema.fields
    schema = StructType([*frame.schema.fields, *more])
    types = [pyarrow.from_numpy_dtype(_NUMPY[f.dataType.typeName()]) for f in more]

    def run(batches: Iterator) -> Iterator:
        current, state = None, start
        for batch in batches:
            out = []
            columns = [batch.column(names.index(c)).to_pylist() for c in (*keys, *values)]
            for row in zip(*columns):
                key = row[: len(keys)]
                if key != current:
                    current, state = key, start
                state, made = step(state, *row[len(keys) :])
                out.append(made)
            new = [pyarrow.array([x[k] for x in out], t) for k, t in enumerate(types)]
            yield pyarrow.RecordBatch.from_arrays([*batch.columns, *new], names=[f.name for f in schema.fields])

    names = frame.columns
    dealt = frame.repartition(*keys).sortWithinPartitions(*keys, *order)
    return map_arrow(dealt, run, schema)


_NUMPY = {"long": "int64", "integer": "int32", "double": "float64", "boolean": "bool"}


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, keys, how) where a null key equals another."""
    other = right.withColumnsRenamed({k: f"{k}__right" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__right")) for k in keys])
    return left.join(other, same, how).drop(*[f"{k}__right" for k in keys])


def small(frame: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """`frame`, marked for broadcast if its counted rows are within the bound, else left to the optimizer.

    For tables that are written or cheap: the count runs them once.
    """
    return F.broadcast(frame) if frame.limit(max_rows + 1).count() <= max_rows else frame
