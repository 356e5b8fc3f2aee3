"""Health score, anomaly flags, trends and bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: score weights, targets and thresholds -----------------------------------
STEPS_TARGET, STEPS_WEIGHT = 10000.0, 45.0
SLEEP_TARGET, SLEEP_SPAN, SLEEP_WEIGHT = 480.0, 240.0, 35.0
ACTIVE_TARGET, ACTIVE_WEIGHT = 60.0, 20.0
LOW_Z, HIGH_Z = -1.5, 1.5
RISING, FALLING = 1.1, 0.9
BAND_HIGH, BAND_MIDDLE = 80, 50
ARROWS = {"increasing": "↑", "decreasing": "↓", "stable": "→"}
# --------------------------------------------------------------------------------------------


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def health_score(steps: Column, sleep_minutes: Column, active_minutes: Column) -> Column:
    """0 to 100; a missing input counts as zero, which also zeroes the sleep part."""
    one, zero = F.lit(1.0), F.lit(0.0)
    walking = F.least(_or_zero(steps) / F.lit(STEPS_TARGET), one) * F.lit(STEPS_WEIGHT)
    off_target = F.abs(_or_zero(sleep_minutes) - F.lit(SLEEP_TARGET)) / F.lit(SLEEP_SPAN)
    sleeping = F.greatest(zero, one - off_target) * F.lit(SLEEP_WEIGHT)
    moving = F.least(_or_zero(active_minutes) / F.lit(ACTIVE_TARGET), one) * F.lit(ACTIVE_WEIGHT)
    return walking + sleeping + moving


def anomaly_flags(sleep_z: Column, steps_z: Column, resting_hr_z: Column) -> dict[str, Column]:
    return {
        "anomaly_low_sleep": sleep_z <= F.lit(LOW_Z),
        "anomaly_low_activity": steps_z <= F.lit(LOW_Z),
        "anomaly_high_resting_hr": resting_hr_z >= F.lit(HIGH_Z),
    }


def any_anomaly() -> Column:
    return F.col("anomaly_low_sleep") | F.col("anomaly_low_activity") | F.col("anomaly_high_resting_hr")


def steps_trend(latest: Column, mean: Column) -> Column:
    """Latest steps against the recent mean; a missing latest value counts as zero."""
    today = _or_zero(latest)
    return (
        F.when(today > mean * F.lit(RISING), "increasing")
        .when(today < mean * F.lit(FALLING), "decreasing")
        .otherwise("stable")
    )


def score_band(score: Column) -> Column:
    return F.when(score > BAND_HIGH, "high").when(score > BAND_MIDDLE, "middle").otherwise("low")


def sleep_split(minutes: Column) -> tuple[Column, Column]:
    """Whole hours and the minutes left over."""
    whole = minutes.cast("bigint")
    sixty = F.lit(60).cast("bigint")
    rest = F.pmod(whole, sixty)
    return F.floor((whole - rest) / sixty).cast("bigint"), rest


def trend_arrow(trend: Column) -> Column:
    return (
        F.when(trend == "increasing", ARROWS["increasing"])
        .when(trend == "decreasing", ARROWS["decreasing"])
        .otherwise(ARROWS["stable"])
    )
