"""Tracker CSV exports: daily activity and sleep, melted to one row per metric."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.clock import us_clock
from pulseframe.functions.numbers import blank_to_null, number
from pulseframe.sources.canonical import canonical, lookup, unreadable, with_absent
from pulseframe.sources.csv_files import NAMED_FILES, read_by_header
from pulseframe.sources.infer import ACTIVITY_FILE, SLEEP_FILE, file_name

# ---- fixed values: column -> metric and unit -----------------------------------------------
ACTIVITY_COLUMNS = {
    "TotalSteps": ("steps", "count"),
    "Calories": ("calories", "kcal"),
    "VeryActiveMinutes": ("very_active_minutes", "min"),
    "FairlyActiveMinutes": ("fairly_active_minutes", "min"),
    "LightlyActiveMinutes": ("lightly_active_minutes", "min"),
    "SedentaryMinutes": ("sedentary_minutes", "min"),
}
SLEEP_COLUMNS = {
    "TotalMinutesAsleep": ("sleep_minutes", "min"),
    "TotalTimeInBed": ("time_in_bed_minutes", "min"),
}
# --------------------------------------------------------------------------------------------


def _read(spark: SparkSession, paths: list[str], date_column: str, columns: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    needed = ["Id", date_column, *columns]
    return read_by_header(spark, paths, needed, date_column, lambda names: F.array_contains(names, "Id") & F.array_contains(names, date_column))


def read_activity(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows, and the files that lack the id or date column."""
    return _read(spark, paths, "ActivityDate", ACTIVITY_COLUMNS)


def read_sleep(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    return _read(spark, paths, "SleepDay", SLEEP_COLUMNS)


def _melt(frame: DataFrame, date_column: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One event per metric column; an absent column or a blank cell is 0."""
    dated = with_absent(frame, list(columns)).select("Id", us_clock(F.col(date_column)).alias("timestamp"), *columns)
    long = dated.unpivot(["Id", "timestamp"], list(columns), "column", "cell")
    cell = blank_to_null(F.col("cell"))
    return canonical(
        long,
        timestamp=F.col("timestamp"),
        metric=lookup({name: pair[0] for name, pair in columns.items()}, F.col("column")),
        value=F.when(cell.isNull(), F.lit(0.0)).otherwise(number(cell)),
        unit=lookup({name: pair[1] for name, pair in columns.items()}, F.col("column")),
        source=F.lit("fitbit"),
        user=F.col("Id"),
        metadata={"column": F.col("column")},
    )


def activity_events(frame: DataFrame) -> DataFrame:
    return _melt(frame, "ActivityDate", ACTIVITY_COLUMNS)


def sleep_events(frame: DataFrame) -> DataFrame:
    return _melt(frame, "SleepDay", SLEEP_COLUMNS)


def fitbit_events(spark: SparkSession, paths: list[str], strict: bool = True) -> DataFrame:
    """Both kinds of file, told apart by name; other files are ignored.

    A file without the needed columns is an error, or is set aside where ``strict`` is off.
    """
    activity = [path for path in paths if ACTIVITY_FILE in file_name(path)]
    sleep = [path for path in paths if SLEEP_FILE in file_name(path)]
    parts, headless = [], []
    for files, read, shape in ((activity, read_activity, activity_events), (sleep, read_sleep, sleep_events)):
        if files:
            rows, without = read(spark, files)
            parts.append(shape(rows))
            headless.append(without)
    if not parts:
        raise FileNotFoundError("a tracker import needs a daily activity or a sleep CSV file")
    without = reduce(DataFrame.unionByName, headless)
    if not strict:
        return reduce(DataFrame.unionByName, [*parts, unreadable(without, "fitbit")])
    named = without.take(NAMED_FILES)
    if named:
        raise ValueError(f"no Id and date columns (ActivityDate, SleepDay) in: {', '.join(row.file for row in named)}")
    return reduce(DataFrame.unionByName, parts)
