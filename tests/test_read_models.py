from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pulseframe.plans import (
    chat_context,
    correlation_payload,
    dataset_profile,
    insight_payload,
    latest_day,
    overview_payload,
    recent_anomalies,
    report_rows,
    select_user,
    trend_slice,
    user_stats,
)
from pulseframe.schema import CORRELATION_PAIRS, OVERVIEW_COLUMNS, OVERVIEW_DAILY, PAIR_COLUMNS

OVERVIEW_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OVERVIEW_DAILY.fields if f.name in OVERVIEW_COLUMNS)
PAIR_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CORRELATION_PAIRS.fields if f.name in PAIR_COLUMNS)


def day_row(user, index, steps=1000.0, sleep=400.0, score=50.25, low_sleep=False, high_hr=False):
    return (user, dt.date(2024, 1, 1) + dt.timedelta(days=index), steps, sleep, None, None, 60.5, None, score, 0.0, 0.0, 0.0, 0.0, low_sleep, False, high_hr)


@pytest.fixture(scope="module")
def overview(spark):
    rows = [day_row("long", i, steps=1000.0 + i, low_sleep=i % 2 == 0, high_hr=i == 28) for i in range(30)]
    rows += [day_row("short", 0, steps=None, sleep=None, score=0.0)]
    return spark.createDataFrame(rows, OVERVIEW_DDL)


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [("long", "steps", f"m{i}", i % 2, 0.1 * i * (-1) ** i, 10 + i) for i in range(1, 8)]
    return spark.createDataFrame(rows, PAIR_DDL)


def test_slices(overview):
    assert trend_slice(overview).groupBy("source_user_id").count().collect() != []
    counts = {r.source_user_id: r["count"] for r in trend_slice(overview).groupBy("source_user_id").count().collect()}
    assert counts == {"long": 21, "short": 1}
    flagged = recent_anomalies(overview).orderBy("day").collect()
    assert [f.day.day for f in flagged] == [17, 19, 21, 23, 25, 27, 29]
    assert (flagged[-1].low_sleep, flagged[-1].low_activity, flagged[-1].high_resting_hr) == (True, False, True)
    newest = {r.source_user_id: r for r in latest_day(overview).collect()}
    assert newest["long"].steps == 1029.0 and newest["long"].health_score == 50.2 and newest["short"].steps is None


def test_overview_payload(spark, overview):
    wanted = spark.createDataFrame([("long",), ("short",), ("nobody",)], "source_user_id string")
    rows = {r.source_user_id: r for r in overview_payload(overview, wanted).collect()}
    assert set(rows) == {"long", "short", "nobody"}
    assert [t.day.day for t in rows["long"].trend_slices] == list(range(10, 31))
    assert rows["long"].latest.day == dt.date(2024, 1, 30) and len(rows["long"].anomalies) == 7
    assert rows["nobody"].latest is None and rows["nobody"].trend_slices == [] and rows["nobody"].anomalies == []
    assert overview_payload(overview.where("false")).count() == 0


def test_correlation_payload(pairs):
    row = correlation_payload(pairs).first()
    assert [p.metric_b for p in row.pairs] == ["m7", "m6", "m5", "m4", "m3", "m2", "m1"]
    assert row.matrix == {"steps": {"m6": 0.6, "m4": 0.4, "m2": 0.2}, "m6": {"steps": 0.6}, "m4": {"steps": 0.4}, "m2": {"steps": 0.2}}
    lagged = correlation_payload(pairs, lag_days=1).first()
    assert [p.metric_b for p in lagged.pairs] == ["m7", "m5", "m3", "m1"] and lagged.matrix == row.matrix


def test_user_stats(overview):
    rows = {r.source_user_id: r for r in user_stats(overview).collect()}
    assert (rows["long"].steps, rows["long"].steps_7d_avg, rows["long"].steps_trend, rows["long"].sleep_7d_avg) == (1029, 1026, "stable", 400)
    assert rows["long"].anomalies.low_sleep is False and rows["long"].health_score == 50.2
    assert (rows["short"].steps, rows["short"].steps_7d_avg, rows["short"].steps_trend, rows["short"].sleep_7d_avg) == (0, 0, "stable", 0)


def test_insight_and_chat_json(overview, pairs):
    bodies = {r.source_user_id: json.loads(r.payload) for r in insight_payload(overview, pairs).collect()}
    assert list(bodies["long"]) == ["date", "metrics", "trends", "anomalies", "correlations"]
    assert bodies["long"]["metrics"] == {"steps": 1029, "sleep_minutes": 400, "health_score": 50.2, "resting_hr": 60.5, "hrv": None}
    assert [c["metric_b"] for c in bodies["long"]["correlations"]] == ["m7", "m6", "m5"]
    assert bodies["long"]["correlations"][0] == {"metric_a": "steps", "metric_b": "m7", "lag_days": 1, "correlation": -0.7, "sample_size": 17}
    assert bodies["short"]["correlations"] == []
    assert "correlations" not in json.loads(insight_payload(overview).first().payload)
    chat = {r.source_user_id: json.loads(r.payload) for r in chat_context(overview, pairs).collect()}
    assert len(chat["long"]["correlations"]) == 5 and len(chat["long"]["overview"]["trend_slices"]) == 21


def test_report(overview, pairs):
    rows = report_rows(overview, pairs).orderBy("source_user_id", "section", "position").collect()
    text = {(r.source_user_id, r.section, r.position): (r.label, r.text) for r in rows}
    assert text["long", "Latest Metrics", 0] == ("Latest day", "2024-01-30")
    assert text["long", "Latest Metrics", 1] == ("Health score", "50.2")
    assert text["long", "Latest Metrics", 2] == ("Steps", "1029.0")
    assert text["long", "Latest Metrics", 5] == ("HRV", "n/a")
    anomalies = [text["long", "Recent Anomalies", i] for i in range(1, 6)]
    assert anomalies[0] == ("2024-01-21", "low sleep") and anomalies[-1] == ("2024-01-29", "low sleep, high resting HR")
    assert ("long", "Recent Anomalies", 6) not in text
    assert text["long", "Strongest Correlations", 1] == ("steps vs m7 (lag 1d)", "corr=-0.7 across 17 samples")
    assert text["short", "Recent Anomalies", 1] == ("", "No recent anomaly flags.")
    assert text["short", "Strongest Correlations", 1] == ("", "Not enough data for correlation analysis yet.")


def test_profile(overview):
    row = dataset_profile(overview).first()
    assert (row.days, row.weeks, row.first_day, row.last_day) == (30, 4.3, dt.date(2024, 1, 1), dt.date(2024, 1, 30))
    assert (row.low_sleep, row.low_activity, row.high_resting_hr, row.anomalies) == (15, 0, 1, 16)
    empty = dataset_profile(overview.where("false")).first()
    assert (empty.days, empty.anomalies, empty.first_day) == (0, 0, None)


def test_select_user(spark, overview):
    events = spark.createDataFrame([(dt.datetime(2024, 5, 1), "short"), (dt.datetime(2024, 4, 1), "long")], "timestamp timestamp_ntz, source_user_id string")
    assert [r.source_user_id for r in select_user(overview, events).select("source_user_id").distinct().collect()] == ["short"]
    assert select_user(overview, events, "long").count() == 30
    assert select_user(overview, events.where(F.lit(False))).count() == 0
