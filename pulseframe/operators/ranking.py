"""Newest days, strongest pairs, latest user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.schema import USER


def newest_days(overview: DataFrame, count: int) -> DataFrame:
    """The last ``count`` rows of each user with ``recency`` 1 for the newest."""
    newest_first = Window.partitionBy(USER).orderBy(F.col("day").desc())
    return overview.withColumn("recency", F.row_number().over(newest_first)).where(F.col("recency") <= count)


def pair_order() -> list[Column]:
    """Strongest first, then by name and lag.

    The strength is compared to 9 places: pairs that differ by rounding noise only (a score that is
    a linear function of one metric, say) keep one stable order on any cluster layout.
    """
    return [F.round(F.abs("correlation"), 9).desc(), F.col("metric_a"), F.col("metric_b"), F.col("lag_days")]


def pair_rank(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("position", F.row_number().over(Window.partitionBy(USER).orderBy(*pair_order())))


def top_pairs(pairs: DataFrame, count: int) -> DataFrame:
    return pair_rank(pairs).where(F.col("position") <= count)


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(USER, *pair_order())


def latest_user(events: DataFrame, time: str = "timestamp") -> DataFrame:
    """The user of the newest event, the greatest name winning a tie; no row without events."""
    newest = F.max(F.struct(time, USER)).alias("newest")
    return events.agg(newest).where(F.col("newest").isNotNull()).select(f"newest.{USER}")


def users(events: DataFrame) -> DataFrame:
    return events.select(USER).distinct().orderBy(USER)
