"""Watch messages, already decoded to a table with one row per message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.sources.canonical import canonical, lookup, with_absent

# ---- fixed values: message field -> metric and unit ----------------------------------------
MESSAGE_FIELDS = {
    "steps": ("steps", "count"),
    "calories": ("calories", "kcal"),
    "heart_rate": ("heart_rate", "bpm"),
    "resting_heart_rate": ("resting_hr", "bpm"),
}
# --------------------------------------------------------------------------------------------

MESSAGE_DDL = (
    "message_name string, timestamp timestamp_ntz, steps double, calories double, heart_rate double, "
    "resting_heart_rate double, user_profile_index string"
)


def read_garmin(spark: SparkSession, paths: list[str], format: str = "json") -> DataFrame:
    """Messages as JSON lines, or any columnar format Spark reads."""
    return spark.read.schema(MESSAGE_DDL).format(format).load(paths)


def garmin_events(messages: DataFrame) -> DataFrame:
    """Four fields of every message that has a time; a null field gives no row."""
    fields = list(MESSAGE_FIELDS)
    kept = with_absent(with_absent(messages, ["message_name", "user_profile_index"]), fields, "double").where(
        F.col("timestamp").isNotNull()
    )
    typed = kept.withColumns({name: F.col(name).cast("double") for name in fields})
    long = typed.unpivot(["message_name", "timestamp", "user_profile_index"], fields, "field", "reading")
    return canonical(
        long.where(F.col("reading").isNotNull()),
        timestamp=F.col("timestamp").cast("timestamp_ntz"),
        metric=lookup({name: pair[0] for name, pair in MESSAGE_FIELDS.items()}, F.col("field")),
        value=F.col("reading"),
        unit=lookup({name: pair[1] for name, pair in MESSAGE_FIELDS.items()}, F.col("field")),
        source=F.lit("garmin"),
        user=F.coalesce(F.col("user_profile_index").cast("string"), F.lit("garmin-user")),
        metadata={"message_name": F.col("message_name"), "field": F.col("field")},
    )
