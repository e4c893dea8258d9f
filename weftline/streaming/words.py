"""Structured Streaming over event tables: running counts by window, with late data bounded by a watermark.

The reference workload has no unbounded stream; this extends it. Each function takes a batch table as well, so that streams
can be held against batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, batch_files: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files with the schema they have."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", batch_files).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, events, value) of tumbling windows."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("value")).select(F.col("window.start").alias("start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, events) of sessions that a gap ends."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return grouped.agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
