"""Optional extension: the batch trends over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def daily_trend(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by day and type; a day is closed when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def hits(events: DataFrame, length: str = "5 minutes", step: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Hits of each user in sliding windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "user_id").agg(F.count("*").alias("hits")).select("w.start", "w.end", "user_id", "hits")
