"""What a client reads: latest day, trend, recent anomalies and ranked pairs, for all users at once.

Arrays are collected only after a per-user row limit that is part of the model (21 days, 14 days,
42 pairs), so no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.numbers import python_round
from pulseframe.functions.wellbeing import any_anomaly
from pulseframe.operators.correlation import at_lag
from pulseframe.operators.ranking import latest_user, newest_days, pair_rank
from pulseframe.schema import ANOMALY_FLAGS, TREND_METRICS, USER

TREND_DAYS = 21
ANOMALY_DAYS = 14


def select_user(frame: DataFrame, events: DataFrame, user: str | None = None) -> DataFrame:
    """Rows of one user; by default the user of the newest event (a single row, hence the broadcast)."""
    if user is not None:
        return frame.where(F.col(USER) == user)
    return frame.join(F.broadcast(latest_user(events)), USER, "left_semi")


def latest_day(overview: DataFrame) -> DataFrame:
    return newest_days(overview, 1).select(
        USER, "day", "steps", "sleep_minutes", "resting_hr", "hrv", python_round(F.col("health_score"), 1).alias("health_score")
    )


def trend_slice(overview: DataFrame) -> DataFrame:
    return newest_days(overview, TREND_DAYS).select(USER, "day", *TREND_METRICS)


def flag_columns() -> list:
    return [F.col(flag).alias(flag.removeprefix("anomaly_")) for flag in ANOMALY_FLAGS]


def recent_anomalies(overview: DataFrame) -> DataFrame:
    """Flagged days among the last 14 rows: the window is taken first, then the flags."""
    return newest_days(overview, ANOMALY_DAYS).where(any_anomaly()).select(USER, "day", *flag_columns())


def overview_payload(overview: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row per user: ``latest``, ``trend_slices`` and ``anomalies``, both lists in day order.

    With ``wanted`` (a frame of user ids) each of those users gets a row, empty where it has no days.
    """
    recent = newest_days(overview, TREND_DAYS)
    newest = F.struct(
        "day", "steps", "sleep_minutes", "resting_hr", "hrv", python_round(F.col("health_score"), 1).alias("health_score")
    )
    flagged = (F.col("recency") <= ANOMALY_DAYS) & any_anomaly()
    payload = recent.groupBy(USER).agg(
        F.max_by(newest, "day").alias("latest"),
        F.array_sort(F.collect_list(F.struct("day", *TREND_METRICS))).alias("trend_slices"),
        F.array_sort(F.collect_list(F.when(flagged, F.struct("day", *flag_columns())))).alias("anomalies"),
    )
    if wanted is None:
        return payload
    lists = {name: F.coalesce(name, F.array().cast(payload.schema[name].dataType)) for name in ("trend_slices", "anomalies")}
    return wanted.select(USER).distinct().join(payload, USER, "left").withColumns(lists)


def correlation_payload(pairs: DataFrame, lag_days: int | None = None) -> DataFrame:
    """One row per user: the same-day ``matrix`` and the ranked ``pairs``, at most 42 of them.

    ``lag_days`` narrows the pair list only; the matrix always shows the same day.
    """
    rounded = pair_rank(pairs).withColumn("correlation", python_round(F.col("correlation"), 3))
    listed = F.lit(True) if lag_days is None else F.col("lag_days") == lag_days
    row = F.struct("position", "metric_a", "metric_b", "lag_days", "correlation", "sample_size")
    grouped = rounded.groupBy(USER).agg(
        F.array_sort(F.collect_list(F.when(listed, row))).alias("pairs"),
        F.array_sort(F.collect_list(F.when(F.col("lag_days") == 0, row))).alias("same_day"),
    )

    def cell(metric: str, other: str):
        return lambda p: F.struct(p[metric].alias("metric"), p[other].alias("other"), p["correlation"].alias("r"))

    cells = F.concat(F.transform("same_day", cell("metric_a", "metric_b")), F.transform("same_day", cell("metric_b", "metric_a")))
    names = F.array_distinct(F.transform("cells", lambda c: c["metric"]))
    matrix = F.map_from_arrays(
        names,
        F.transform(
            names,
            lambda name: F.map_from_entries(
                F.transform(F.filter("cells", lambda c: c["metric"] == name), lambda c: F.struct(c["other"], c["r"]))
            ),
        ),
    )
    return grouped.withColumn("cells", cells).select(USER, matrix.alias("matrix"), "pairs")


def pair_list(pairs: DataFrame, lag_days: int | None = None) -> DataFrame:
    """The ranked pairs as flat rows."""
    return pair_rank(at_lag(pairs, lag_days)).select(
        USER,
        "position",
        "metric_a",
        "metric_b",
        "lag_days",
        python_round(F.col("correlation"), 3).alias("correlation"),
        "sample_size",
    )


def dataset_profile(overview: DataFrame) -> DataFrame:
    """Days covered, date range and anomaly totals."""
    counts = {flag.removeprefix("anomaly_"): F.count_if(flag) for flag in ANOMALY_FLAGS}
    days = F.countDistinct("day")
    return overview.agg(
        days.alias("days"),
        python_round(days / F.lit(7.0), 1).alias("weeks"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        *[column.alias(name) for name, column in counts.items()],
        sum(counts.values(), F.lit(0)).alias("anomalies"),
    )
