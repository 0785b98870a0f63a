"""Pipeline status as a stream: progress over event time, and the latest state of each key. An extension, not parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import half_even


def events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def per_window(rows: DataFrame, late: str = "1 day", size: str = "1 hour") -> DataFrame:
    """Counts and sums of each type and window; works on streams and tables."""
    if rows.isStreaming:
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    else:
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def latest(rows: DataFrame, key: str = "user_id") -> DataFrame:
    return rows.groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("last_update"))


def progress(rows: DataFrame, key: str = "user_id") -> DataFrame:
    """Running count and percent of each key's events."""
    own = Window.partitionBy(key).orderBy("ts", "event_id")
    every = F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.withColumn("current", F.row_number().over(own)).withColumn("total", every).withColumn("percent", (F.col("current") * 100 / F.col("total")).cast("int"))


def eta(rows: DataFrame) -> DataFrame:
    """Percent, seconds since the stage began, and the seconds left at its pace; rows: current, total, began and now in seconds.

    Nothing is left when all is done; before the first item no pace is known.
    """
    good, some = F.col("total") > 0, (F.col("current") > 0) & (F.col("current") < F.col("total"))
    took = F.col("now") - F.col("began")
    left = F.when(some, half_even(took / F.col("current") * (F.col("total") - F.col("current")), 2)).when(F.col("current") >= F.col("total"), 0.0)
    return rows.withColumn("percent", F.when(good, half_even(F.col("current") * 100 / F.col("total"), 2))).withColumn("stage_elapsed_seconds", F.when(good, half_even(took, 2))).withColumn("eta_seconds", F.when(good, left))


def stamped(rows: DataFrame) -> DataFrame:
    """Rows with the time of writing, in UTC, as ISO 8601 with a Z."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return rows.withColumn("generated_at", F.concat(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))


def append(rows: DataFrame, path: str) -> None:
    """Status rows are appended; the state of a key is its last row (``latest``)."""
    stamped(rows).write.mode("append").parquet(path)
