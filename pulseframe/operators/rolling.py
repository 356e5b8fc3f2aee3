"""Rolling statistics over the last rows of each user.

The window input holds at most one row per user and day, so the largest window partition is
bounded by the number of calendar days, however many events one user has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.schema import USER

WINDOW_ROWS = 30
MIN_VALUES = 3


def rolling_frame(rows: int = WINDOW_ROWS):
    """The current row and the ``rows - 1`` before it, gaps between days notwithstanding."""
    return Window.partitionBy(USER).orderBy("day").rowsBetween(1 - rows, Window.currentRow)


def _finite(value: Column) -> Column:
    return F.when(F.abs(value) < float("inf"), value)


def rolling_stats(metric: str, rows: int = WINDOW_ROWS, min_values: int = MIN_VALUES) -> tuple[Column, Column]:
    """Rolling mean and sample deviation, null below ``min_values`` and for a zero deviation."""
    frame = rolling_frame(rows)
    value = _finite(F.col(metric))
    seen = F.count(value).over(frame)
    deviation = F.stddev_samp(value).over(frame)
    # A sum over the count, which the size test needs anyway: one aggregate less per frame than avg.
    mean = F.sum(value).over(frame) / seen
    return F.when(seen >= min_values, mean), F.when((seen >= min_values) & (deviation != 0.0), deviation)


def rolling_zscore(days: DataFrame, metrics: Sequence[str], rows: int = WINDOW_ROWS, min_values: int = MIN_VALUES) -> DataFrame:
    """Add ``<metric>_zscore`` for each metric; an undefined score is 0."""
    scores = {}
    for metric in metrics:
        mean, deviation = rolling_stats(metric, rows, min_values)
        score = F.try_divide(F.col(metric) - mean, deviation)
        scores[f"{metric}_zscore"] = F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))
    return days.withColumns(scores)
