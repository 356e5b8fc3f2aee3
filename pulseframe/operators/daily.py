"""Long events to one row per user and day.

The aggregates are plain sums and counts, so Spark combines them before the shuffle: a user
holding a third of all events sends at most one row per day and map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.numbers import real
from pulseframe.schema import SUM_METRICS, USER, WIDE_METRICS


def event_day() -> Column:
    return F.to_date("timestamp")


def daily_reduce(events: DataFrame) -> DataFrame:
    """Every metric per user and day: additive metrics summed, the others averaged."""
    reduced = F.when(F.col("metric").isin(*SUM_METRICS), F.col("total")).otherwise(F.col("total") / F.col("n"))
    return (
        events.groupBy(USER, event_day().alias("day"), "metric")
        .agg(F.sum("value").alias("total"), F.count("value").alias("n"))
        .select(USER, "day", "metric", reduced.alias("value"))
    )


def pivot_daily(daily: DataFrame) -> DataFrame:
    """Reduced long rows to the six wide columns; days with other metrics only keep a row."""
    return daily.groupBy(USER, "day").pivot("metric", list(WIDE_METRICS)).agg(F.first("value", ignorenulls=True))


def daily_partials(events: DataFrame) -> DataFrame:
    """Mergeable day totals per user and day: newest event, and sum and count of each wide metric."""
    totals: list[Column] = [F.max("timestamp").alias("last_event")]
    for metric in WIDE_METRICS:
        mine = F.when(F.col("metric") == metric, F.col("value"))
        totals += [F.sum(mine).alias(f"{metric}_sum"), F.count(mine).alias(f"{metric}_n")]
    return events.groupBy(USER, event_day().alias("day")).agg(*totals)


def merge_partials(partials: DataFrame) -> DataFrame:
    """Totals of several imports to one row per user and day."""
    totals = [F.max("last_event").alias("last_event")]
    totals += [F.sum(f"{metric}_{part}").alias(f"{metric}_{part}") for metric in WIDE_METRICS for part in ("sum", "n")]
    return partials.groupBy(USER, "day").agg(*totals)


def finish_partials(totals: DataFrame) -> DataFrame:
    """Day totals to the six wide metric values."""
    columns = []
    for metric in WIDE_METRICS:
        total = F.col(f"{metric}_sum")
        value = total if metric in SUM_METRICS else F.try_divide(total, F.col(f"{metric}_n"))
        columns.append(real(value).alias(metric))
    return totals.select(USER, "day", *columns)


def daily_wide(events: DataFrame) -> DataFrame:
    """Reduce and pivot in one aggregation, hence one shuffle."""
    return finish_partials(daily_partials(events))
