"""Bars and sessions on streams of timed events.  An extension: the same transformations run on batch tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in windows of a length, as bars count notes; rows later than `late` are left out on streams."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's runs of events less than a gap apart, as pedals merge."""
    runs = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return runs.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
