"""Text files as tables, and tables as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import clean


def subjects(spark: SparkSession, path: str) -> DataFrame:
    """subject: one to a line; an en dash becomes a hyphen, empty lines go."""
    return spark.read.text(path).select(F.btrim(F.replace("value", F.lit("–"), F.lit("-"))).alias("subject")).filter("subject <> ''")


def narratives(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files, cleaned and with marks at the ends of sentences."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), clean(F.col("value")).alias("text"))


def characters(spark: SparkSession, path: str) -> DataFrame:
    """path, at, ch: the characters of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.filter(F.split("value", ""), lambda c: c != "")).alias("at", "ch"))


def strokes(spark: SparkSession, path: str) -> DataFrame:
    """ch, frequency, strokes: lines of three fields; those without strokes go."""
    parts = spark.read.text(path).select(F.split(F.btrim("value"), r"\s+").alias("p")).filter(F.size("p") >= 3)
    return parts.select(F.col("p")[0].alias("ch"), F.expr("try_cast(p[1] AS int)").alias("frequency"), F.expr("try_cast(p[2] AS int)").alias("strokes")).filter("strokes > 0")


def stroke_work(texts: DataFrame, table: DataFrame, text: str = "text") -> DataFrame:
    """text, work: half the strokes of a text's characters; the table is of fixed size (about 13,000 rows)."""
    each = texts.select(text).distinct().select(text, F.explode(F.split(text, "")).alias("ch"))
    return each.join(F.broadcast(table.select("ch", "strokes")), "ch", "left").groupBy(text).agg((F.sum(F.coalesce("strokes", F.lit(0))) / 2).alias("work"))


def first_lines(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    return spark.read.text(path).limit(n)


def append_values(frame: DataFrame, path: str, *columns: str) -> None:
    """Columns as text, a row to a line, with six decimals."""
    frame.select(F.concat_ws(" ", *[F.format_string("%f", F.col(c).cast("double")) for c in columns]).alias("value")).write.mode("append").text(path)


def write_points(frame: DataFrame, path: str) -> None:
    """Rows as space-separated values for plotting; an earlier run's files are replaced."""
    frame.write.mode("overwrite").option("sep", " ").csv(path)
