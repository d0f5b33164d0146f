"""Curves and means of group sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEANS = (4, 8, 30, 150, 500)


def mean_size(frame: DataFrame, column: str) -> DataFrame:
    return frame.agg(F.avg(column).alias("mean"))


def expected_size(histogram: DataFrame) -> DataFrame:
    """Sum of n * p."""
    return histogram.agg(F.sum(F.col("n") * F.col("p")).alias("expected"))


def rounded_counts(frame: DataFrame, column: str, scale: float = 600.0, most: int = 14) -> DataFrame:
    """n, scaled: counts of the values rounded to 1 .. most, times a scale; 0 where none is."""
    counts = frame.groupBy(F.floor(F.col(column) + 0.5).alias("n")).agg(F.count(F.lit(1)).alias("c"))
    grid = frame.sparkSession.range(1, most + 1).select(F.col("id").alias("n"))
    return grid.join(counts, "n", "left").select("n", (F.coalesce("c", F.lit(0)) * scale).alias("scaled"))


def group_curve(spark: SparkSession, means=MEANS, most: int = 40) -> DataFrame:
    """n, mean, f: 4 sqrt(v) exp(-v) / (1.77 mean), v = 2 (n - 1) / mean."""
    grid = spark.range(1, most + 1).select(F.col("id").alias("n"), F.explode(F.array(*[F.lit(float(m)) for m in means])).alias("mean"))
    v = 2 * (F.col("n") - 1) / F.col("mean")
    return grid.select("n", "mean", (4 * F.sqrt(v) * F.exp(-v) / (F.col("mean") * 1.77)).alias("f"))


def hierarchy(spark: SparkSession, betas=(1.0, 0.93), start: float = 5.0, limit: float = 600.0) -> DataFrame:
    """beta, level, size: sizes n <- (n - 1) 4 beta from a start while within the limit."""
    rows = ", ".join(f"(CAST({b} AS DOUBLE))" for b in betas)
    return spark.sql(
        f"""WITH RECURSIVE levels(beta, level, size) AS (
          SELECT beta, 0, CAST({start} AS DOUBLE) FROM VALUES {rows} AS t(beta)
          UNION ALL SELECT beta, level + 1, (size - 1) * 4 * beta FROM levels WHERE (size - 1) * 4 * beta <= {limit})
        SELECT beta, level, size FROM levels"""
    )
