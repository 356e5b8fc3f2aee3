"""Pairwise metric correlations per user, same day and next row."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions.numbers import python_round, real
from pulseframe.schema import CORRELATED_METRICS, USER

MIN_SAMPLES = 3
LAGS = (0, 1)


def with_next_row(overview: DataFrame, *more: str) -> DataFrame:
    """Add ``next_<metric>``: the value on the user's next recorded day."""
    ahead = Window.partitionBy(USER).orderBy("day")
    return overview.select(
        USER,
        "day",
        *more,
        *CORRELATED_METRICS,
        *[F.lead(metric, 1).over(ahead).alias(f"next_{metric}") for metric in CORRELATED_METRICS],
    )


PAIRS = [(first, second, lag) for first, second in combinations(CORRELATED_METRICS, 2) for lag in LAGS]


def pair_samples(overview: DataFrame, fresh: str | None = None) -> DataFrame:
    """One row (user, pair, x, y) per day and pair where both values are present.

    ``fresh`` names a boolean column: then only samples that end on a row where it holds are taken.

    ``pair`` is the place in ``PAIRS``: grouping by a number is far cheaper than by two names. The
    fan-out is a fixed 42 per day, combined again before any shuffle; rows of one user already share
    a partition here, so the aggregation above it needs no further exchange.
    """
    rows = with_next_row(overview, *([fresh] if fresh else []))
    if fresh:
        ends = F.lead(fresh, 1).over(Window.partitionBy(USER).orderBy("day"))
        rows = rows.withColumn("next_fresh", F.coalesce(ends, F.lit(False)))

    def taken(first: str, lag: int) -> Column:
        return F.when(F.col("next_fresh" if lag else fresh), F.col(first)) if fresh else F.col(first)

    samples = [
        F.struct(F.lit(place).alias("pair"), taken(first, lag).alias("x"), F.col(f"next_{second}" if lag else second).alias("y"))
        for place, (first, second, lag) in enumerate(PAIRS)
    ]
    fanned = rows.select(USER, F.inline(F.array(*samples)))
    return fanned.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def pair_names() -> list[Column]:
    """The two metric names and the lag behind ``pair``."""
    columns = []
    for part, name in enumerate(("metric_a", "metric_b", "lag_days")):
        table = F.array(*[F.lit(pair[part]) for pair in PAIRS])
        columns.append(F.get(table, F.col("pair")).alias(name))
    return columns


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r in [-1, 1]; null for a constant side, where ``corr`` would fail under ANSI mode."""
    ratio = real(F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)))
    return F.when(ratio.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))


def correlate_samples(samples: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Drop pairs below ``min_samples`` and those without a defined correlation."""
    grouped = samples.groupBy(USER, "pair").agg(
        pearson(F.col("x"), F.col("y")).alias("correlation"), F.count(F.lit(1)).cast("int").alias("sample_size")
    )
    kept = grouped.where((F.col("sample_size") >= min_samples) & F.col("correlation").isNotNull())
    return kept.select(USER, *pair_names(), "correlation", "sample_size")


def correlation_pairs(overview: DataFrame) -> DataFrame:
    return correlate_samples(pair_samples(overview))


def search_pairs(pairs: DataFrame, text: str) -> DataFrame:
    """Pairs whose two names contain ``text``, ignoring case; empty text keeps all."""
    names = F.lower(F.concat_ws(" ", "metric_a", "metric_b"))
    return pairs.where(names.contains(text.lower()))


def at_lag(pairs: DataFrame, lag_days: int | None) -> DataFrame:
    return pairs if lag_days is None else pairs.where(F.col("lag_days") == lag_days)


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    """Same-day correlations in both directions, rounded to 3 places."""
    both = F.array(
        F.struct(F.col("metric_a").alias("metric"), F.col("metric_b").alias("other")),
        F.struct(F.col("metric_b").alias("metric"), F.col("metric_a").alias("other")),
    )
    value = python_round(F.col("correlation"), 3).alias("correlation")
    return at_lag(pairs, 0).select(USER, value, F.inline(both)).select(USER, "metric", "other", "correlation")


def matrix_wide(pairs: DataFrame) -> DataFrame:
    """The matrix with one column per metric."""
    return (
        correlation_matrix(pairs)
        .groupBy(USER, "metric")
        .pivot("other", list(CORRELATED_METRICS))
        .agg(F.first("correlation", ignorenulls=True))
    )


def heatmap(pairs: DataFrame) -> DataFrame:
    """A full grid per user over the metrics its matrix names: 1 on the diagonal, 0 where empty.

    A user has at most 21 same-day pairs and 7 labels, so each group is of fixed size.
    """
    strongest_first = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.round(F.abs("correlation"), 9)).alias("strength"),
                "metric_a",
                "metric_b",
                python_round(F.col("correlation"), 3).alias("correlation"),
            )
        )
    )
    names = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.array(c["metric_a"], c["metric_b"]))))
    lookup = F.map_from_entries(
        F.flatten(
            F.transform(
                "cells",
                lambda c: F.array(
                    F.struct(F.concat_ws("|", c["metric_a"], c["metric_b"]), c["correlation"]),
                    F.struct(F.concat_ws("|", c["metric_b"], c["metric_a"]), c["correlation"]),
                ),
            )
        )
    )
    grid = (
        at_lag(pairs, 0)
        .groupBy(USER)
        .agg(strongest_first.alias("cells"))
        .select(USER, names.alias("labels"), lookup.alias("lookup"))
        .select(USER, "labels", "lookup", F.posexplode("labels").alias("row_position", "row_label"))
        .select(USER, "lookup", "row_position", "row_label", F.posexplode("labels").alias("column_position", "column_label"))
    )
    found = F.try_element_at("lookup", F.concat_ws("|", "row_label", "column_label"))
    filler = F.when(F.col("row_label") == F.col("column_label"), 1.0).otherwise(0.0)
    return grid.select(
        USER, "row_position", "row_label", "column_position", "column_label", F.coalesce(found, filler).alias("correlation")
    )
