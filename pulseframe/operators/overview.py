"""The daily overview: metrics, score, rolling z-scores and anomaly flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.wellbeing import anomaly_flags, health_score
from pulseframe.operators.daily import daily_wide
from pulseframe.operators.rolling import rolling_zscore
from pulseframe.schema import OVERVIEW_COLUMNS, ROLLING_METRICS


def overview_from_wide(wide: DataFrame, *more: str) -> DataFrame:
    """Overview rows of wide days; ``more`` names columns to carry along."""
    scored = wide.withColumn("health_score", health_score(F.col("steps"), F.col("sleep_minutes"), F.col("active_minutes")))
    zscored = rolling_zscore(scored, ROLLING_METRICS).withColumnRenamed("sleep_minutes_zscore", "sleep_zscore")
    flags = anomaly_flags(F.col("sleep_zscore"), F.col("steps_zscore"), F.col("resting_hr_zscore"))
    return zscored.withColumns(flags).select(*OVERVIEW_COLUMNS, *more)


def daily_overview(events: DataFrame) -> DataFrame:
    return overview_from_wide(daily_wide(events))
