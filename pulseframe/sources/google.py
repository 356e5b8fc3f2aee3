"""Takeout JSON: a list of data points, or an object holding them under ``points``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions.clock import epoch_nanos
from pulseframe.functions.numbers import number
from pulseframe.sources.canonical import canonical, lookup, with_absent

# ---- fixed values: data type -> metric and default unit ------------------------------------
DATA_TYPES = {
    "com.google.step_count.delta": ("steps", "count"),
    "com.google.calories.expended": ("calories", "kcal"),
    "com.google.heart_rate.bpm": ("heart_rate", "bpm"),
    "com.google.resting_heart_rate.bpm": ("resting_hr", "bpm"),
    "com.google.heart_minutes": ("active_minutes", "min"),
    "com.google.hrv": ("hrv", "ms"),
}
# --------------------------------------------------------------------------------------------

# Numbers are read as text: exports hold 64-bit integers both quoted and bare.
def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType(), True) for name in names]


_NESTED = T.StructType([T.StructField("value", T.StructType(_text("fpVal")), True)])
_FIT = T.StructType([*_text("intVal", "fpVal"), T.StructField("mapVal", T.ArrayType(_NESTED), True)])
POINT = T.StructType(
    [
        *_text("dataTypeName", "metric", "originDataSourceId", "startTimeNanos", "unit", "value"),
        T.StructField("fitValue", T.ArrayType(_FIT), True),
    ]
)
EXPORT = T.StructType([T.StructField("points", T.ArrayType(POINT), True), *POINT.fields, *_text("_corrupt_record")])


def read_google(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per data point, and one marked ``broken`` per unreadable document.

    A JSON document is one task; the work spreads over files.
    """
    documents = spark.read.schema(EXPORT).option("multiLine", "true").json(paths)
    bare = F.array(F.struct(*[F.col(name) for name in POINT.fieldNames()]))
    listed = F.when(F.coalesce(*[F.col(name) for name in ("dataTypeName", "metric")]).isNotNull(), bare)
    broken = F.col("_corrupt_record").isNotNull()
    return documents.select(broken.alias("broken"), F.inline(F.when(broken, bare).otherwise(F.coalesce(F.col("points"), listed))))


def _nonzero(value: Column) -> Column:
    return F.nullif(value, F.lit(0.0))


def google_events(points: DataFrame) -> DataFrame:
    """The first usable of float, integer and nested map value; the plain value without a fit value."""
    kind = F.coalesce(F.nullif(F.col("dataTypeName"), F.lit("")), F.col("metric"))
    first = F.get("fitValue", F.lit(0))
    nested = F.get(first["mapVal"], F.lit(0))["value"]["fpVal"]
    measured = F.coalesce(*[_nonzero(number(part)) for part in (first["fpVal"], first["intVal"], nested)], F.lit(0.0))
    plain = number(F.coalesce(F.col("value"), F.lit("0")))
    broken = F.coalesce(F.col("broken"), F.lit(False))
    return canonical(
        with_absent(points, ["broken"], "boolean").where(broken | kind.isin(*DATA_TYPES)),
        timestamp=epoch_nanos(F.col("startTimeNanos")),
        metric=lookup({name: pair[0] for name, pair in DATA_TYPES.items()}, kind),
        value=F.when(F.size(F.coalesce("fitValue", F.array())) > 0, measured).otherwise(plain),
        unit=F.coalesce(F.col("unit"), lookup({name: pair[1] for name, pair in DATA_TYPES.items()}, kind)),
        source=F.lit("google_health"),
        user=F.coalesce(F.col("originDataSourceId"), F.lit("google-user")),
        metadata={"data_type_name": kind},
        broken=broken,
    )
