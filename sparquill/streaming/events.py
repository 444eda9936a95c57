"""The events table as a stream: windowed counts with late rows, beyond what a batch reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, best): counts and the best value by window; rows later than ``late`` are let go."""
    kept = events.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("best")).select(F.col("w.start").alias("start"), "event_type", "n", "best")
