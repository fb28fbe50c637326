"""Event streams: an extension beyond the batch operators.

Sources are any streaming DataFrame with event_id, ts, user_id, event_type, value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_folder(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_rates(events: DataFrame, *, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; events later than the watermark are dropped by the state's own rule."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


def first_seen(events: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Each event id once, remembered as long as the watermark asks."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("started"), "n")
