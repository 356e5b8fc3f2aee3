"""File names behind paths, as Spark sees them."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import SparkSession


def file_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files behind paths, folders and globs: one name per file, no contents read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path")
    return sorted(unquote(row.path) for row in names.collect())

