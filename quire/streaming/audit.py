"""Audit events as a stream: the latest value of each key, and counts of actions in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(events: DataFrame) -> DataFrame:
    """The last event of each user; on a stream in update or complete mode it follows the appends."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*")


def actions_by_window(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling windows; late ones are waited for on a stream."""
    base = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        base = base.withWatermark("at", late)
    return base.groupBy(F.window("at", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
