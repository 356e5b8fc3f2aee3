from pulseframe.functions.clock import clock_minutes, epoch_nanos, iso_clock, offset_clock, us_clock
from pulseframe.functions.numbers import blank_to_null, float_text, number, python_round, real
from pulseframe.functions.wellbeing import (
    anomaly_flags,
    any_anomaly,
    health_score,
    score_band,
    sleep_split,
    steps_trend,
    trend_arrow,
)

__all__ = [
    "anomaly_flags",
    "any_anomaly",
    "blank_to_null",
    "clock_minutes",
    "epoch_nanos",
    "float_text",
    "health_score",
    "iso_clock",
    "number",
    "offset_clock",
    "python_round",
    "real",
    "score_band",
    "sleep_split",
    "steps_trend",
    "trend_arrow",
    "us_clock",
]
