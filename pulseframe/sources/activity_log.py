"""Canonical events from a product activity log (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.schema import USER

# event type -> metric, unit, scale, offset; errors split into two heart metrics by id parity.
EVENT_TYPES = {
    "view": ("steps", "count", 100.0, 0.0),
    "signup": ("sleep_minutes", "min", 6.0, 0.0),
    "click": ("active_minutes", "min", 1.0, 0.0),
    "purchase": ("calories", "kcal", 20.0, 0.0),
    "error": ("hrv", "ms", 0.2, 50.0),
}


def _pick(position: int) -> Column:
    choice = None
    for kind, row in EVENT_TYPES.items():
        test, value = F.col("event_type") == kind, F.lit(row[position])
        choice = F.when(test, value) if choice is None else choice.when(test, value)
    return choice


def activity_events(log: DataFrame) -> DataFrame:
    odd_error = (F.col("event_type") == "error") & (F.pmod("event_id", F.lit(2)) == 1)
    return log.select(
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        F.when(odd_error, "resting_hr").otherwise(_pick(0)).alias("metric"),
        (_pick(3) + F.col("value") * _pick(2)).alias("value"),
        F.when(odd_error, "bpm").otherwise(_pick(1)).alias("unit"),
        F.lit("activity_log").alias("source"),
        F.col("user_id").cast("string").alias(USER),
        F.col("props").alias("metadata_json"),
    )


def read_activity_log(spark: SparkSession, folder: str) -> DataFrame:
    return activity_events(spark.read.parquet(f"{folder}/events.parquet"))
