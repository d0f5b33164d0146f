"""Times on a week: five-minute slots, and labels to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOT_SECONDS = 300
SLOTS = 7 * 24 * 12
#: Where the week's grid starts (seconds).
GRID_START = 345200
SHIFTS = ("Night", "Morning", "Afternoon", "Evening")


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def torus_slot(ts: Column) -> Column:
    """Mon:Hr05:Min10_15. The session's time zone counts; it should be UTC."""
    start = (F.minute(ts) - F.minute(ts) % 5).cast("int")
    return F.concat(F.date_format(ts, "EEE"), F.lit(":Hr"), _two(F.hour(ts)), F.lit(":Min"), _two(start), F.lit("_"), _two((start + 5) % 60))


def torus_label(ts: Column) -> Column:
    start = (F.minute(ts) - F.minute(ts) % 5).cast("int")
    shift = F.element_at(F.array(*map(F.lit, SHIFTS)), (F.floor(F.hour(ts) / 6) + 1).cast("int"))
    return F.concat(
        shift, F.lit(","), F.date_format(ts, "EEEE"), F.lit(",Day"), F.day(ts).cast("string"), F.lit(","), F.date_format(ts, "MMMM"), F.lit(",Yr"), F.year(ts).cast("string"),
        F.lit(" at Hr"), _two(F.hour(ts)), F.lit(" Min"), _two(F.minute(ts)), F.lit(" Q"), (F.floor(F.minute(ts) / 15) + 1).cast("string"), F.lit(" Min"), _two(start), F.lit("_"), _two((start + 5) % 60),
    )


def week_slots(spark: SparkSession) -> DataFrame:
    """idx, slot: the 2016 slots of a week in order of the grid."""
    grid = spark.range(SLOTS).select(F.col("id").cast("int").alias("idx"), F.timestamp_seconds(F.lit(GRID_START) + F.col("id") * SLOT_SECONDS).alias("ts"))
    return grid.select("idx", torus_slot(F.col("ts")).alias("slot"))
