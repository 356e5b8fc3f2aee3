"""Phone health export: XML with one ``Record`` element per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions.clock import clock_minutes, offset_clock
from pulseframe.functions.numbers import number
from pulseframe.sources.canonical import canonical, computed_once, lookup

# ---- fixed values: record type -> metric and default unit ----------------------------------
RECORD_TYPES = {
    "HKQuantityTypeIdentifierStepCount": ("steps", "count"),
    "HKQuantityTypeIdentifierHeartRateVariabilitySDNN": ("hrv", "ms"),
    "HKQuantityTypeIdentifierRestingHeartRate": ("resting_hr", "count/min"),
    "HKQuantityTypeIdentifierHeartRate": ("heart_rate", "count/min"),
    "HKQuantityTypeIdentifierActiveEnergyBurned": ("calories", "kcal"),
    "HKQuantityTypeIdentifierDistanceWalkingRunning": ("distance", "km"),
    "HKCategoryTypeIdentifierSleepAnalysis": ("sleep_minutes", "min"),
}
SLEEP_TYPE = "HKCategoryTypeIdentifierSleepAnalysis"
ASLEEP = "HKCategoryValueSleepAnalysisAsleep"
# --------------------------------------------------------------------------------------------

ATTRIBUTES = ("type", "sourceName", "device", "unit", "value", "startDate", "endDate")
RECORD = T.StructType([T.StructField(f"_{name}", T.StringType(), True) for name in ATTRIBUTES])


#: Attributes of a tag; quoted values may hold a ``>``.
_ATTRIBUTES = r"""((?:\s+[^\s=>"'/]+\s*=\s*(?:"[^"]*"|'[^']*'))*)\s*"""
#: A start tag without its ``<``.
START_TAG = f"^Record{_ATTRIBUTES}/?>"


def _tags(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per tag, whatever lines it spans: text files cut at ``<``, which stands nowhere else in well-formed XML.

    Such files split like any text, so one large export is many tasks. ``split`` and ``place`` order the tags of a file.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "<").text(paths)
    return text.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place")
    )


def _parsed(tags: DataFrame) -> DataFrame:
    """Attributes of ``Record`` start tags; text that is no such tag gives no row."""
    tag = F.regexp_extract("value", START_TAG, 1)
    element = F.from_xml(F.concat(F.lit("<Record"), tag, F.lit("/>")), RECORD, {"ignoreSurroundingSpaces": "false"})
    return tags.where(F.col("value").rlike(START_TAG)).select(computed_once(element.alias("record"))).select("record.*")


def read_apple(spark: SparkSession, paths: list[str], nested_in: str | None = "Correlation") -> DataFrame:
    """Records of a wanted type that are direct children of the export, from one scan.

    Exports repeat the members of a ``Correlation`` as top-level records, so records inside such a group are left out: those before which
    more groups have begun than ended. That count runs along each split of a file, from what earlier splits leave open: one exchange by split.
    Pass ``nested_in=None`` for exports known to have no groups; then nothing is
    exchanged. Elements in comments count as elements.
    """
    wanted = F.col("_type").isin(*RECORD_TYPES)
    name = F.regexp_extract("value", r"^/?[^\s/>]+", 0)
    tags = _tags(spark, paths).withColumn("name", name)
    if not nested_in:
        return _parsed(tags.where(F.col("name") == "Record")).where(wanted)
    begins = (F.col("name") == nested_in) & ~F.col("value").rlike(f"^{nested_in}{_ATTRIBUTES}/>")
    tags = tags.withColumn("step", F.when(begins, 1).when(F.col("name") == f"/{nested_in}", -1).otherwise(0).cast("long"))
    tags = tags.where((F.col("name") == "Record") | (F.col("step") != 0))
    # What each split with marks of groups leaves open: a few rows a file.
    order = Window.partitionBy("file").orderBy("split")
    marks = tags.where("step <> 0").groupBy("file", "split").agg(F.sum("step").alias("steps"))
    marks = marks.select("file", F.struct("split", F.sum("steps").over(order).alias("open")).alias("mark"))
    marks = marks.groupBy("file").agg(F.sort_array(F.collect_list("mark")).alias("marks"))
    earlier = F.try_element_at(F.filter("marks", lambda m: m.split < F.col("split")), F.lit(-1)).open
    inside = F.sum("step").over(Window.partitionBy("file", "split").orderBy("place"))
    placed = tags.withColumn("inside", inside).where(F.col("name") == "Record").join(marks, "file", "left")
    return _parsed(placed.where(F.col("inside") + F.coalesce(earlier, F.lit(0)) <= 0)).where(wanted)


def apple_events(records: DataFrame, asleep_only: bool = False) -> DataFrame:
    """Sleep lasts from start to end and belongs to its start day; other values are read as numbers. ``asleep_only`` leaves out sleep records
    of other categories, such as time in bed or awake; a sleep record without a category then goes, too."""
    if asleep_only:
        asleep = F.coalesce(F.col("_value").startswith(ASLEEP), F.lit(False))
        records = records.where((F.col("_type") != SLEEP_TYPE) | asleep)
    kind, start = F.col("_type"), F.col("_startDate")
    metric = lookup({name: pair[0] for name, pair in RECORD_TYPES.items()}, kind)
    default_unit = lookup({name: pair[1] for name, pair in RECORD_TYPES.items()}, kind)
    source_name = F.coalesce(F.col("_sourceName"), F.lit("apple_health"))
    asleep = clock_minutes(start, F.coalesce(F.col("_endDate"), start))
    value = F.when(metric == "sleep_minutes", asleep).otherwise(number(F.coalesce(F.col("_value"), F.lit("0"))))
    return canonical(
        records.where(kind.isin(*RECORD_TYPES)),
        timestamp=offset_clock(start),
        metric=metric,
        value=value,
        unit=F.coalesce(F.col("_unit"), default_unit),
        source=F.lit("apple_health"),
        user=F.coalesce(F.col("_device"), source_name),
        metadata={"record_type": kind, "source_name": source_name},
    )
