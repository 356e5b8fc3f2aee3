"""Which vendor wrote a set of files, judged by their names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: file names that decide a source -----------------------------------------
XML_EXPORT = "export.xml"
ACTIVITY_FILE = "dailyactivity_merged.csv"
SLEEP_FILE = "sleepday_merged.csv"
# --------------------------------------------------------------------------------------------


# A file written by Spark is a folder of that name holding part files.
PART_FILE = "/part-[^/]*$"


def file_name(path: str) -> str:
    """The lower-case name that tells the vendor."""
    return re.sub(PART_FILE, "", path.rstrip("/")).rsplit("/", 1)[-1].lower()


def _file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(path, PART_FILE, ""), "/"), -1))


def source_by_name(name: Column) -> Column:
    """The vendor of a single lower-case file name; null when it cannot be told."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return (
        F.when(name == XML_EXPORT, "apple_health")
        .when(name.isin(ACTIVITY_FILE, SLEEP_FILE), "fitbit")
        .when(name.endswith(".json") & stem.contains("oura"), "oura")
        .when(name.endswith(".json"), "google_health")
        .when(name.endswith(".fit"), "garmin")
        .when(name.endswith(".csv"), "manual")
    )


def classify_files(files: DataFrame) -> DataFrame:
    """Add ``source`` to a frame with a ``path`` column, file by file."""
    return files.withColumn("source", source_by_name(_file_name(F.col("path"))))


def classify_uploads(files: DataFrame) -> DataFrame:
    """One row per folder: its file count and vendor.

    A well-known file anywhere in the folder decides; otherwise the first file by name does.
    """
    name = _file_name(F.col("path"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    merged = (
        files.groupBy(folder.alias("folder"))
        .agg(
            F.count(F.lit(1)).alias("file_count"),
            F.max(name == XML_EXPORT).alias("has_export"),
            F.max(name.isin(ACTIVITY_FILE, SLEEP_FILE)).alias("has_tracker"),
            F.min(name).alias("first_name"),
        )
    )
    source = (
        F.when(F.col("has_export"), "apple_health").when(F.col("has_tracker"), "fitbit").otherwise(source_by_name(F.col("first_name")))
    )
    return merged.select("folder", "file_count", source.alias("source"))


def infer_source(paths: list[str]) -> str:
    """The vendor of one upload given as a list of paths; a well-known name wins, then the first file."""
    names = [file_name(path) for path in paths]
    if XML_EXPORT in names:
        return "apple_health"
    if ACTIVITY_FILE in names or SLEEP_FILE in names:
        return "fitbit"
    stem, _, suffix = names[0].rpartition(".")
    by_suffix = {"json": "oura" if "oura" in stem else "google_health", "fit": "garmin", "csv": "manual"}
    if suffix not in by_suffix:
        raise ValueError(f"cannot tell the source of: {', '.join(sorted(set(names)))}")
    return by_suffix[suffix]
