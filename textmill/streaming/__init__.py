"""Structured Streaming forms: extensions on the events table; the reference data model has no event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """events with ts as an instant; watermarks do not take a timestamp without a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by tumbling window and type; rows later than `late` are ignored by the stream."""
    return timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_seen(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without repeats of an event_id within the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
