"""Ring JSON export: one object per user with daily ``sleep`` and ``activity`` sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions.clock import iso_clock
from pulseframe.functions.numbers import number
from pulseframe.sources.canonical import canonical, with_absent

# ---- fixed values: section -> field -> metric, unit, divisor -------------------------------
SECTIONS = {
    "sleep": {
        "total_sleep_duration": ("sleep_minutes", "min", 60.0),
        "hr_average": ("resting_hr", "bpm", 1.0),
        "hrv_average": ("hrv", "ms", 1.0),
    },
    "activity": {
        "steps": ("steps", "count", 1.0),
        "active_calories": ("calories", "kcal", 1.0),
        "active_duration": ("active_minutes", "min", 60.0),
    },
}
# --------------------------------------------------------------------------------------------


def _section_type(fields: dict) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, T.StringType(), True) for name in ("day", *fields)]))


EXPORT = T.StructType(
    [T.StructField("user_id", T.StringType(), True)]
    + [T.StructField(section, _section_type(fields), True) for section, fields in SECTIONS.items()]
    + [T.StructField("_corrupt_record", T.StringType(), True)]
)


def read_oura(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per export document, ``broken`` where it cannot be read."""
    documents = spark.read.schema(EXPORT).option("multiLine", "true").json(paths)
    return documents.select("user_id", *SECTIONS, F.col("_corrupt_record").isNotNull().alias("broken"))


def _readings(section: str, field: str, metric: str, unit: str, divisor: float) -> Column:
    """One field of a section as an array of readings, empty where the section is absent."""
    fixed = {"divisor": divisor, "metric": metric, "unit": unit, "section": section, "field": field}
    return F.transform(
        F.coalesce(section, F.array().cast(EXPORT[section].dataType)),
        lambda row: F.struct(
            row["day"].alias("day"), row[field].alias("cell"), *[F.lit(value).alias(name) for name, value in fixed.items()]
        ),
    )


def oura_events(documents: DataFrame) -> DataFrame:
    """All sections of a document in one pass; an absent field gives no row."""
    readings = [_readings(section, field, *row) for section, fields in SECTIONS.items() for field, row in fields.items()]
    known = with_absent(documents, ["broken"], "boolean")
    rows = known.select("user_id", "broken", F.inline_outer(F.concat(*readings)))
    long = rows.where(F.col("cell").isNotNull() | F.col("broken"))
    return canonical(
        long,
        timestamp=iso_clock(F.col("day")),
        metric=F.col("metric"),
        value=number(F.col("cell")) / F.col("divisor"),
        unit=F.col("unit"),
        source=F.lit("oura"),
        user=F.coalesce(F.col("user_id"), F.lit("oura-user")),
        metadata={"section": F.col("section"), "field": F.col("field")},
        broken=F.col("broken"),
    )
