"""Files of any supported vendor to canonical events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulseframe.schema import SOURCES
from pulseframe.sources.apple import apple_events, read_apple
from pulseframe.sources.canonical import accepted
from pulseframe.sources.fitbit import fitbit_events
from pulseframe.sources.garmin import garmin_events, read_garmin
from pulseframe.sources.google import google_events, read_google
from pulseframe.sources.infer import ACTIVITY_FILE, SLEEP_FILE, file_name, infer_source
from pulseframe.sources.listing import file_paths
from pulseframe.sources.manual import manual_file_events
from pulseframe.sources.oura import oura_events, read_oura

LOADERS: dict[str, Callable[[SparkSession, list[str], bool], DataFrame]] = {
    "apple_health": lambda spark, paths, strict: apple_events(read_apple(spark, paths)),
    "google_health": lambda spark, paths, strict: google_events(read_google(spark, paths)),
    "fitbit": fitbit_events,
    "oura": lambda spark, paths, strict: oura_events(read_oura(spark, paths)),
    "garmin": lambda spark, paths, strict: garmin_events(read_garmin(spark, paths)),
    "manual": manual_file_events,
}


def parse_files(spark: SparkSession, paths: list[str], source: str | None = None, strict: bool = True) -> DataFrame:
    """Events plus ``reject_reason``; every path is read, not only the first.

    ``strict`` makes a CSV file without the needed columns an error; otherwise it is set aside.
    """
    chosen = source or infer_source(paths)
    if chosen not in LOADERS:
        raise ValueError(f"source {chosen!r} is not supported; choose one of {', '.join(SOURCES)}")
    return LOADERS[chosen](spark, paths, strict)


def load_events(spark: SparkSession, paths: list[str], source: str | None = None) -> DataFrame:
    """The usable events of the given files."""
    return accepted(parse_files(spark, paths, source))


def sample_files(spark: SparkSession, folder: str) -> list[str]:
    """The tracker sample files present in a folder."""
    return [path for path in file_paths(spark, [folder]) if file_name(path) in (ACTIVITY_FILE, SLEEP_FILE)]
