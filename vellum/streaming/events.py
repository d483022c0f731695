"""The event log as a stream: latest stage by paper, and tumbling counts with a watermark (the latter Spark's own addition)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def latest_stage(events: DataFrame) -> DataFrame:
    """By user, the stage and value of the event with the largest (ts, event_id)."""
    last = F.max(F.struct("ts", "event_id", "event_type", "value")).alias("last")
    return events.groupBy("user_id").agg(last).select("user_id", F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"), F.col("last.value").alias("value"))


def counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
