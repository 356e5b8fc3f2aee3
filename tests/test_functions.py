from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulseframe.functions import (
    blank_to_null,
    epoch_nanos,
    float_text,
    health_score,
    iso_clock,
    number,
    offset_clock,
    python_round,
    score_band,
    sleep_split,
    steps_trend,
    trend_arrow,
    us_clock,
)
from pulseframe.functions.clock import clock_minutes


def evaluate(spark, column, values, kind="string"):
    """One result per input value, in order."""
    frame = spark.createDataFrame([(i, value) for i, value in enumerate(values)], f"i int, x {kind}")
    return [row.y for row in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_rounding_equals_pythons(spark):
    rng = random.Random(7)
    values = [k / d for k in range(-300, 300) for d in (8, 16, 20, 40, 200, 2000)]
    values += [rng.uniform(-2, 2) for _ in range(2000)] + [rng.uniform(0, 100) for _ in range(2000)] + [0.05, 0.35, 0.25, 1e13]
    for digits in (1, 2, 3):
        got = evaluate(spark, lambda x: python_round(x, digits), values, "double")
        assert [repr(g) for g in got] == [repr(round(v, digits)) for v in values]


def test_float_text_equals_pythons(spark):
    values = [0.0, 1.0, -3.5, 7421.0, 12345678.0, 1e7, 98765432.125, 0.00025, 43.2, 1 / 3]
    assert evaluate(spark, float_text, values, "double") == [str(v) for v in values]


def test_numbers(spark):
    texts = ["12", " 3.5 ", "-1e3", ".5", "5.", "oops", "5f", "0x10", "", None, "nan", "inf"]
    assert evaluate(spark, number, texts) == [12.0, 3.5, -1000.0, 0.5, 5.0, None, None, None, None, None, None, float("inf")]


def test_blank_cells(spark):
    assert evaluate(spark, blank_to_null, ["NA", "", "null", "x", None]) == [None, None, None, "x", None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_clock_parsing_ignores_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert evaluate(spark, us_clock, ["4/12/2016 12:00:00 AM", "4/12/2016 12:05:00 PM", "4/12/2016 11:05:09 pm", "4/12/2016 13:05", "3/13/2016 2:30:00 AM", "4/1/2026", "2026-04-01T07:00:00", "13/13/2026", "soon", None]) == [
            dt.datetime(2016, 4, 12),
            dt.datetime(2016, 4, 12, 12, 5),
            dt.datetime(2016, 4, 12, 23, 5, 9),
            dt.datetime(2016, 4, 12, 13, 5),
            dt.datetime(2016, 3, 13, 2, 30),
            dt.datetime(2026, 4, 1),
            dt.datetime(2026, 4, 1, 7),
            None,
            None,
            None,
        ]
        assert evaluate(spark, offset_clock, ["2026-04-01 07:00:00 +0530", "2026-04-01 07:00:00", "2026-04-01", "x"]) == [
            dt.datetime(2026, 4, 1, 7),
            dt.datetime(2026, 4, 1, 7),
            dt.datetime(2026, 4, 1),
            None,
        ]
        assert evaluate(spark, iso_clock, ["2026-04-02", "2026-04-02T10:11:12.5+02:00", "bad"]) == [
            dt.datetime(2026, 4, 2),
            dt.datetime(2026, 4, 2, 10, 11, 12, 500000),
            None,
        ]
        assert evaluate(spark, epoch_nanos, ["1711929600000000000", "1711929600123456500", "1.7119296E18", "-1500", "x", None]) == [
            dt.datetime(2024, 4, 1),
            dt.datetime(2024, 4, 1, 0, 0, 0, 123457),
            dt.datetime(2024, 4, 1),
            dt.datetime(1969, 12, 31, 23, 59, 59, 999999),
            None,
            None,
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_durations_use_true_instants(spark):
    rows = [
        ("2026-03-31 23:00:00 +0000", "2026-04-01 06:10:00 +0000", 430.0),
        ("2026-03-31 23:00:00 +0200", "2026-04-01 06:10:00 +0100", 490.0),
        ("2026-03-31 23:00:00 +02:00", "2026-03-31 22:00:00 Z", 60.0),
        ("2026-04-01 06:10:00", "2026-04-01 06:00:00", 0.0),
        ("bad", "2026-04-01 06:00:00", None),
    ]
    frame = spark.createDataFrame(rows, "s string, e string, want double")
    for row in frame.select(clock_minutes(F.col("s"), F.col("e")).alias("got"), "want").collect():
        assert row.got == row.want


@pytest.mark.parametrize(
    "steps, sleep, active, want",
    [
        (10000.0, 480.0, 60.0, 100.0),
        (None, None, None, 0.0),
        (8123.0, None, None, 36.5535),
        (9834.0, 430.0, 75.0, 91.961333),
        (20000.0, 900.0, 0.0, 45.0),
        (None, float("inf"), None, 0.0),
    ],
)
def test_health_score(spark, steps, sleep, active, want):
    frame = spark.createDataFrame([(steps, sleep, active)], "a double, b double, c double")
    assert frame.select(health_score(F.col("a"), F.col("b"), F.col("c")).alias("y")).first().y == pytest.approx(want, abs=1e-6)


def test_trend_band_split_arrow(spark):
    frame = spark.createDataFrame(
        [(1, 111.0, 100.0), (2, 110.0, 100.0), (3, 89.9, 100.0), (4, None, 100.0), (5, 5.0, None)], "i int, latest double, mean double"
    )
    trends = [r.t for r in frame.select("i", steps_trend(F.col("latest"), F.col("mean")).alias("t")).orderBy("i").collect()]
    assert trends == ["increasing", "stable", "decreasing", "decreasing", "stable"]
    assert evaluate(spark, score_band, [80.1, 80.0, 50.1, 50.0], "double") == ["high", "middle", "middle", "low"]
    assert evaluate(spark, lambda x: sleep_split(x)[0], [430, 59, 60], "bigint") == [7, 0, 1]
    assert evaluate(spark, lambda x: sleep_split(x)[1], [430, 59, 60], "bigint") == [10, 59, 0]
    assert evaluate(spark, trend_arrow, ["increasing", "decreasing", "stable"]) == ["↑", "↓", "→"]
