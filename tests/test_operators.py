from __future__ import annotations

import datetime as dt
import random

import brute_force
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import (
    correlation_matrix,
    correlation_pairs,
    daily_overview,
    daily_partials,
    daily_reduce,
    daily_wide,
    heatmap,
    latest_user,
    merge_partials,
    ordered_pairs,
    overview_from_wide,
    pivot_daily,
    rolling_zscore,
    search_pairs,
    top_pairs,
    users,
)
from pulseframe.operators.daily import finish_partials
from pulseframe.schema import CORRELATION_PAIRS, PAIR_COLUMNS, WIDE_METRICS

DDL = "timestamp timestamp_ntz, metric string, value double, source_user_id string"
METRICS = list(WIDE_METRICS) + ["heart_rate", "very_active_minutes"]


def skewed_events(seed, size=3000):
    """One user holds a third of all events and half of those fall on one day; days have gaps."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for _ in range(size):
        hot = rng.random() < 1 / 3
        user = "hot" if hot else f"u{rng.randrange(12)}"
        day = 5 if hot and rng.random() < 0.5 else rng.choice([d for d in range(90) if d % 7])
        metric = rng.choice(METRICS)
        value = rng.choice([60.0, 60.0, 62.0]) if metric == "resting_hr" else round(rng.uniform(0, 4000), 2)
        rows.append((start + dt.timedelta(days=day, seconds=rng.randrange(86400)), metric, value, user))
    return rows


@pytest.fixture(scope="module")
def skewed(spark):
    rows = skewed_events(11)
    return rows, spark.createDataFrame(rows, DDL).cache()


def test_overview_equals_brute_force(skewed):
    rows, events = skewed
    want, _ = brute_force.overview(rows)
    got = daily_overview(events).collect()
    assert len(got) == len(want)
    for row in got:
        expected = want[row.source_user_id, row.day]
        for metric in [*WIDE_METRICS, "health_score"]:
            assert row[metric] == (None if expected[metric] is None else pytest.approx(expected[metric], rel=1e-12, abs=1e-9)), metric
        for column, key in (("steps_zscore", "steps_z"), ("sleep_zscore", "sleep_minutes_z"), ("resting_hr_zscore", "resting_hr_z"), ("hrv_zscore", "hrv_z")):
            assert row[column] == pytest.approx(expected[key], abs=1e-9)
        assert row.anomaly_low_sleep == (expected["sleep_minutes_z"] <= -1.5)
        assert row.anomaly_low_activity == (expected["steps_z"] <= -1.5)
        assert row.anomaly_high_resting_hr == (expected["resting_hr_z"] >= 1.5)


def test_pairs_equal_brute_force(skewed):
    rows, events = skewed
    _, by_user = brute_force.overview(rows)
    want = brute_force.pairs(by_user)
    got = {(p.source_user_id, p.metric_a, p.metric_b, p.lag_days): p for p in correlation_pairs(daily_overview(events)).collect()}
    assert set(got) == set(want)
    for key, (value, size) in want.items():
        assert got[key].correlation == pytest.approx(value, abs=1e-9) and got[key].sample_size == size


def test_reduce_pivot_and_fused_form_agree(skewed):
    _, events = skewed
    fused = {(r.source_user_id, r.day): r for r in daily_wide(events).collect()}
    stepwise = pivot_daily(daily_reduce(events)).collect()
    assert len(stepwise) == len(fused)
    for row in stepwise:
        for metric in WIDE_METRICS:
            other = fused[row.source_user_id, row.day][metric]
            assert row[metric] == (None if other is None else pytest.approx(other))


def test_partials_merge_to_the_whole(skewed):
    _, events = skewed
    early = F.hour("timestamp") < 9
    parts = daily_partials(events.where(early)).unionByName(daily_partials(events.where(~early)))
    merged = {(r.source_user_id, r.day): r for r in finish_partials(merge_partials(parts)).collect()}
    whole = daily_wide(events).collect()
    assert len(whole) == len(merged)
    for row in whole:
        for metric in WIDE_METRICS:
            other = merged[row.source_user_id, row.day][metric]
            assert row[metric] == (None if other is None else pytest.approx(other))


def test_any_metric_makes_a_day(spark):
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "heart_rate", 60.0, "a")], DDL)
    row = daily_overview(events).first()
    assert row.day == dt.date(2024, 1, 1) and row.steps is None and row.health_score == 0.0 and row.steps_zscore == 0.0


def days(spark, values, metric="steps", user="a", gap=1):
    rows = [(user, dt.date(2024, 1, 1) + dt.timedelta(days=i * gap), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"source_user_id string, day date, {metric} double")


def test_window_counts_rows_not_days(spark):
    """Days ten apart still share a 30-row window, and the 31st row back is out of it."""
    frame = days(spark, [1000.0] + [float(i % 3) for i in range(30)], gap=10)
    last = rolling_zscore(frame, ["steps"]).orderBy(F.col("day").desc()).first()
    seen = [float(i % 3) for i in range(30)]
    mean = sum(seen) / 30
    deviation = (sum((v - mean) ** 2 for v in seen) / 29) ** 0.5
    assert last.steps_zscore == pytest.approx((seen[-1] - mean) / deviation)


@pytest.mark.parametrize(
    "values, want",
    [
        ([1.0, 2.0], [0.0, 0.0]),
        ([5.0, 5.0, 5.0, 5.0], [0.0] * 4),
        ([1.0, None, 2.0, None, 3.0], [0.0, 0.0, 0.0, 0.0, 1.0]),
        ([1.0, 2.0, 3.0, None], [0.0, 0.0, 1.0, 0.0]),
        ([1.0, 2.0, 3.0, float("inf")], [0.0, 0.0, 1.0, float("inf")]),
    ],
)
def test_zscore_edges(spark, values, want):
    got = [r.steps_zscore for r in rolling_zscore(days(spark, values), ["steps"]).orderBy("day").collect()]
    assert got == pytest.approx(want)


def test_constant_side_gives_no_pair(spark):
    rows = [("a", dt.date(2024, 1, i + 1), float(i), 7.0, None, None, None, None) for i in range(5)]
    wide = spark.createDataFrame(rows, "source_user_id string, day date, " + ", ".join(f"{m} double" for m in WIDE_METRICS))
    found = {(p.metric_a, p.metric_b, p.lag_days): p.correlation for p in correlation_pairs(overview_from_wide(wide)).collect()}
    assert set(found) == {("steps", "health_score", 0), ("steps", "health_score", 1)}
    assert all(-1.0 <= value <= 1.0 and value == pytest.approx(1.0) for value in found.values())


PAIRS = [
    ("a", "steps", "hrv", 0, 0.5, 9),
    ("a", "steps", "sleep_minutes", 0, -0.9, 9),
    ("a", "calories", "hrv", 1, 0.9, 9),
    ("a", "hrv", "health_score", 0, 0.1234999, 9),
    ("b", "hrv", "health_score", 1, 0.3, 9),
]


@pytest.fixture
def pair_frame(spark):
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CORRELATION_PAIRS.fields if f.name in PAIR_COLUMNS)
    return spark.createDataFrame(PAIRS, kind)


def test_pair_order_search_and_top(pair_frame):
    ordered = [(p.metric_a, p.metric_b) for p in ordered_pairs(pair_frame).where("source_user_id = 'a'").collect()]
    assert ordered == [("calories", "hrv"), ("steps", "sleep_minutes"), ("steps", "hrv"), ("hrv", "health_score")]
    assert search_pairs(pair_frame, "SLEEP").count() == 1
    assert search_pairs(pair_frame, "hrv health").count() == 2
    assert search_pairs(pair_frame, "").count() == 5
    assert [(p.source_user_id, p.position) for p in top_pairs(pair_frame, 2).orderBy("source_user_id", "position").collect()] == [("a", 1), ("a", 2), ("b", 1)]


def test_matrix_and_heatmap(pair_frame):
    cells = {(c.metric, c.other): c.correlation for c in correlation_matrix(pair_frame).collect()}
    assert cells["hrv", "health_score"] == cells["health_score", "hrv"] == 0.123 and len(cells) == 6
    grid = heatmap(pair_frame).orderBy("row_position", "column_position").collect()
    labels = [g.row_label for g in grid if g.column_position == 0]
    assert labels == ["steps", "sleep_minutes", "hrv", "health_score"] and len(grid) == 16
    value = {(g.row_label, g.column_label): g.correlation for g in grid}
    assert value["steps", "steps"] == 1.0 and value["sleep_minutes", "hrv"] == 0.0 and value["hrv", "steps"] == 0.5
    assert {g.source_user_id for g in grid} == {"a"}


def test_latest_user_and_users(spark):
    rows = [(dt.datetime(2024, 1, 2), "m", 1.0, "b"), (dt.datetime(2024, 1, 2), "m", 1.0, "c"), (dt.datetime(2024, 1, 1), "m", 1.0, "z")]
    events = spark.createDataFrame(rows, DDL)
    assert [r[0] for r in latest_user(events).collect()] == ["c"]
    assert [r[0] for r in users(events).collect()] == ["b", "c", "z"]
    assert latest_user(events.where("value > 1")).count() == 0
