"""Streaming over the events table: an extension of this engine's own; windows with watermarks and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files under path as they come."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def per_window(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, value in tumbling windows; events later than late are dropped by a running stream."""
    told = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return told.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n: runs of a user's events with less than gap between them."""
    told = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return told.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
