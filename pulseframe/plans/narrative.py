"""Inputs for a written summary: per-user statistics, the insight object and chat context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.numbers import python_round
from pulseframe.functions.wellbeing import steps_trend
from pulseframe.operators.ranking import newest_days, top_pairs
from pulseframe.plans.read_models import flag_columns, overview_payload
from pulseframe.schema import USER

STATS_DAYS = 7
INSIGHT_PAIRS = 3
CHAT_PAIRS = 5
KEEP_NULLS = {"ignoreNullFields": "false"}


def _whole(value: Column) -> Column:
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def user_stats(overview: DataFrame) -> DataFrame:
    """The latest day of each user against its last 7 rows, nulls skipped and means cut to integers."""
    newest = F.struct("day", "steps", "sleep_minutes", "resting_hr", "hrv", "health_score", *flag_columns())
    recent = (
        newest_days(overview, STATS_DAYS)
        .groupBy(USER)
        .agg(F.max_by(newest, "day").alias("newest"), F.avg("steps").alias("mean_steps"), F.avg("sleep_minutes").alias("mean_sleep"))
    )
    return recent.select(
        USER,
        F.col("newest.day").alias("date"),
        _whole(F.col("newest.steps")).alias("steps"),
        _whole(F.col("mean_steps")).alias("steps_7d_avg"),
        steps_trend(F.col("newest.steps"), F.col("mean_steps")).alias("steps_trend"),
        _whole(F.col("newest.sleep_minutes")).alias("sleep_minutes"),
        _whole(F.col("mean_sleep")).alias("sleep_7d_avg"),
        python_round(F.coalesce("newest.health_score", F.lit(0.0)), 1).alias("health_score"),
        F.col("newest.resting_hr").alias("resting_hr"),
        F.col("newest.hrv").alias("hrv"),
        F.struct("newest.low_sleep", "newest.low_activity", "newest.high_resting_hr").alias("anomalies"),
    )


def strongest_pairs(pairs: DataFrame, count: int) -> DataFrame:
    """One row per user with its ``count`` strongest pairs as a list."""
    row = F.struct(
        "position", "metric_a", "metric_b", "lag_days", python_round(F.col("correlation"), 3).alias("correlation"), "sample_size"
    )
    listed = top_pairs(pairs, count).groupBy(USER).agg(F.array_sort(F.collect_list(row)).alias("ranked"))
    return listed.select(USER, F.transform("ranked", lambda p: p.dropFields("position")).alias("correlations"))


def _with_pairs(frame: DataFrame, pairs: DataFrame, count: int) -> DataFrame:
    strongest = strongest_pairs(pairs, count)
    kind = strongest.schema["correlations"].dataType
    return frame.join(strongest, USER, "left").withColumn("correlations", F.coalesce("correlations", F.array().cast(kind)))


def insight_struct() -> list[Column]:
    return [
        F.col("date"),
        F.struct("steps", "sleep_minutes", "health_score", "resting_hr", "hrv").alias("metrics"),
        F.struct("steps_trend", F.col("sleep_7d_avg").alias("avg_sleep_7d")).alias("trends"),
        F.col("anomalies"),
    ]


def insight_payload(overview: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One JSON object per user; with ``pairs`` it also carries the three strongest."""
    stats = user_stats(overview)
    if pairs is None:
        return stats.select(USER, F.to_json(F.struct(*insight_struct()), KEEP_NULLS).alias("payload"))
    joined = _with_pairs(stats, pairs, INSIGHT_PAIRS)
    return joined.select(USER, F.to_json(F.struct(*insight_struct(), "correlations"), KEEP_NULLS).alias("payload"))


def chat_context(overview: DataFrame, pairs: DataFrame) -> DataFrame:
    """The overview payload and the five strongest pairs as one JSON object per user."""
    joined = _with_pairs(overview_payload(overview), pairs, CHAT_PAIRS)
    body = F.struct(F.struct("latest", "trend_slices", "anomalies").alias("overview"), "correlations")
    return joined.select(USER, F.to_json(body, KEEP_NULLS).alias("payload"))
