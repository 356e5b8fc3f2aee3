"""Canonical table schemas and the metric vocabulary.

Wall-clock times use ``TimestampNTZType``: an event belongs to the day its owner saw on the
clock, whatever the session time zone is.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: metric names and how a day of them is reduced ---------------------------
SUM_METRICS = (
    "steps",
    "sleep_minutes",
    "time_in_bed_minutes",
    "calories",
    "active_minutes",
    "very_active_minutes",
    "fairly_active_minutes",
    "lightly_active_minutes",
    "sedentary_minutes",
)
WIDE_METRICS = ("steps", "sleep_minutes", "calories", "active_minutes", "resting_hr", "hrv")
ROLLING_METRICS = ("steps", "sleep_minutes", "resting_hr", "hrv")
CORRELATED_METRICS = WIDE_METRICS + ("health_score",)
TREND_METRICS = ("steps", "sleep_minutes", "resting_hr", "hrv", "health_score")
ANOMALY_FLAGS = ("anomaly_low_sleep", "anomaly_low_activity", "anomaly_high_resting_hr")
SOURCES = ("apple_health", "google_health", "fitbit", "oura", "garmin", "manual")
# --------------------------------------------------------------------------------------------

USER = "source_user_id"


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


EVENT = _fields(
    ("timestamp", T.TimestampNTZType()),
    ("metric", T.StringType()),
    ("value", T.DoubleType()),
    ("unit", T.StringType()),
    ("source", T.StringType()),
    (USER, T.StringType()),
    ("metadata_json", T.StringType()),
)
EVENT_COLUMNS = tuple(EVENT.fieldNames())

# Stored rows, the unusable ones apart: the last two are partition folders.
RAW_EVENTS = T.StructType(
    EVENT.fields
    + [
        T.StructField("reject_reason", T.StringType(), True),
        T.StructField("ingested_at", T.TimestampType(), True),
        T.StructField("import_id", T.StringType(), True),
        T.StructField("rejected", T.BooleanType(), True),
    ]
)

IMPORT_RUNS = _fields(
    ("source", T.StringType()),
    ("file_count", T.IntegerType()),
    ("record_count", T.LongType()),
    ("user_count", T.LongType()),
    ("created_at", T.TimestampType()),
    ("import_id", T.StringType()),
)

# Mergeable day totals, one row per import, user and day.
DAILY_PARTIALS = _fields(
    (USER, T.StringType()),
    ("day", T.DateType()),
    ("last_event", T.TimestampNTZType()),
    *[(f"{metric}_{part}", kind) for metric in WIDE_METRICS for part, kind in (("sum", T.DoubleType()), ("n", T.LongType()))],
    ("import_id", T.StringType()),
)

OVERVIEW_DAILY = _fields(
    (USER, T.StringType()),
    ("day", T.DateType()),
    ("steps", T.DoubleType()),
    ("sleep_minutes", T.DoubleType()),
    ("calories", T.DoubleType()),
    ("active_minutes", T.DoubleType()),
    ("resting_hr", T.DoubleType()),
    ("hrv", T.DoubleType()),
    ("health_score", T.DoubleType()),
    ("steps_zscore", T.DoubleType()),
    ("sleep_zscore", T.DoubleType()),
    ("resting_hr_zscore", T.DoubleType()),
    ("hrv_zscore", T.DoubleType()),
    ("anomaly_low_sleep", T.BooleanType()),
    ("anomaly_low_activity", T.BooleanType()),
    ("anomaly_high_resting_hr", T.BooleanType()),
    ("updated_at", T.TimestampType()),
)
OVERVIEW_COLUMNS = tuple(name for name in OVERVIEW_DAILY.fieldNames() if name != "updated_at")

CORRELATION_PAIRS = _fields(
    (USER, T.StringType()),
    ("metric_a", T.StringType()),
    ("metric_b", T.StringType()),
    ("lag_days", T.IntegerType()),
    ("correlation", T.DoubleType()),
    ("sample_size", T.IntegerType()),
    ("updated_at", T.TimestampType()),
)
PAIR_COLUMNS = tuple(name for name in CORRELATION_PAIRS.fieldNames() if name != "updated_at")
