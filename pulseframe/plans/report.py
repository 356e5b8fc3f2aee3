"""A printable report as rows of (user, section, position, label, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.numbers import float_text
from pulseframe.plans.narrative import CHAT_PAIRS, _with_pairs
from pulseframe.plans.read_models import overview_payload
from pulseframe.schema import USER

# ---- fixed values: titles, labels and stock sentences --------------------------------------
METRICS_TITLE = "Latest Metrics"
ANOMALIES_TITLE = "Recent Anomalies"
PAIRS_TITLE = "Strongest Correlations"
METRIC_LABELS = {
    "health_score": "Health score",
    "steps": "Steps",
    "sleep_minutes": "Sleep minutes",
    "resting_hr": "Resting HR",
    "hrv": "HRV",
}
FLAG_LABELS = {"low_sleep": "low sleep", "low_activity": "low activity", "high_resting_hr": "high resting HR"}
NO_VALUE = "n/a"
NO_ANOMALIES = "No recent anomaly flags."
NO_PAIRS = "Not enough data for correlation analysis yet."
# --------------------------------------------------------------------------------------------

REPORT_PAIRS = CHAT_PAIRS
REPORT_ANOMALIES = 5


def _row(section: str, position: Column, label: Column, text: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"), position.cast("int").alias("position"), label.alias("label"), text.alias("text")
    )


def flag_text(flags: Column) -> Column:
    return F.concat_ws(", ", *[F.when(flags[name], F.lit(label)) for name, label in FLAG_LABELS.items()])


def pair_label(pair: Column) -> Column:
    return F.concat(pair["metric_a"], F.lit(" vs "), pair["metric_b"], F.lit(" (lag "), pair["lag_days"].cast("string"), F.lit("d)"))


def pair_text(pair: Column) -> Column:
    return F.concat(F.lit("corr="), float_text(pair["correlation"]), F.lit(" across "), pair["sample_size"].cast("string"), F.lit(" samples"))


def _or_stock(rows: Column, section: str, sentence: str) -> Column:
    stock = F.array(_row(section, F.lit(1), F.lit(""), F.lit(sentence)))
    return F.when(F.size(rows) > 0, rows).otherwise(stock)


def report_rows(overview: DataFrame, pairs: DataFrame) -> DataFrame:
    """Latest metrics, the last five flagged days and the five strongest pairs of every user."""
    joined = _with_pairs(overview_payload(overview), pairs, REPORT_PAIRS)
    newest = F.col("latest")
    metrics = F.array(
        _row(METRICS_TITLE, F.lit(0), F.lit("Latest day"), newest["day"].cast("string")),
        *[
            _row(METRICS_TITLE, F.lit(place), F.lit(label), F.coalesce(float_text(newest[name]), F.lit(NO_VALUE)))
            for place, (name, label) in enumerate(METRIC_LABELS.items(), start=1)
        ],
    )
    size = F.size("anomalies")
    last_flagged = F.slice("anomalies", F.greatest(size - (REPORT_ANOMALIES - 1), F.lit(1)), F.lit(REPORT_ANOMALIES))
    anomalies = F.transform(
        last_flagged, lambda day, i: _row(ANOMALIES_TITLE, i + 1, day["day"].cast("string"), flag_text(day))
    )
    strongest = F.transform("correlations", lambda pair, i: _row(PAIRS_TITLE, i + 1, pair_label(pair), pair_text(pair)))
    rows = F.concat(metrics, _or_stock(anomalies, ANOMALIES_TITLE, NO_ANOMALIES), _or_stock(strongest, PAIRS_TITLE, NO_PAIRS))
    return joined.select(USER, F.inline(rows))
