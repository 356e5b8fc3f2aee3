"""CSV files whose headers may differ from file to file."""

from __future__ import annotations

import csv
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.session import scratch
from pulseframe.sources.canonical import computed_once

#: An error message names this many files.
NAMED_FILES = 20
LINE_OPTIONS = {"ignoreLeadingWhiteSpace": "true"}


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").text(paths).where(F.trim("value") != "")
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def header_index(spark: SparkSession, paths: list[str], hint: str, is_header: Callable[[Column], Column]) -> DataFrame:
    """(file, header): the first line of each file that is a header, as a table in the shared folder; other files are not in it.

    ``hint`` is text any header holds in some case; it spares most lines the split. Spark cannot end the reading of a file early, so this is
    a scan of all lines, with few rows out of it.
    """
    names = F.transform(F.split(F.regexp_replace("value", "^\\ufeff", ""), ","), lambda f: F.regexp_replace(f, '^\\s*"?|"?\\s*$', ""))
    lines = _lines(spark, paths).withColumn("place", F.struct("block", F.monotonically_increasing_id()))
    headers = lines.where(F.lower("value").contains(hint.lower()) & is_header(names))
    path = scratch(spark, "headers")
    headers.groupBy("file").agg(F.min_by("value", "place").alias("header")).write.parquet(path)
    return spark.read.schema("file string, header string").parquet(path)


def _names(header: str) -> list[str]:
    return [name.strip() for name in next(csv.reader([header.lstrip("\ufeff")], skipinitialspace=True))]


def read_by_header(
    spark: SparkSession,
    paths: list[str],
    needed: list[str],
    hint: str,
    is_header: Callable[[Column], Column],
    name_of: Callable[[str], str] = lambda name: name,
) -> tuple[DataFrame, DataFrame]:
    """The ``needed`` columns of CSV files as text, found by each file's own header, and the files without a header.

    Spark applies one column order to all files of a read, which would mix up columns between exports of different versions. So lines are
    read as text and meet the header of their file in a join by file; a join by broadcast only where the index of headers is small.
    Distinct headers (a handful of versions, however many files) come to the driver, files do not. A needed column that a file lacks is null; of two
    columns of one name, as ``name_of`` gives it, the last one counts. Lines equal to the header of their file are no rows.
    Files without a header come as a frame of one column, ``file``; files of no bytes are passed over.
    """
    index = header_index(spark, paths, hint, is_header)
    versions = []
    for row in index.select("header").distinct().collect():
        names = _names(row.header)
        last = {name_of(name): place for place, name in enumerate(names)}
        versions.append((row.header, len(names), [last.get(name) for name in needed]))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(F.col("_metadata.file_path").alias("file"))
    headless = files.join(index, "file", "left_anti")
    if not versions:
        return spark.createDataFrame([], ", ".join(f"`{name}` string" for name in needed)), headless

    known = spark.createDataFrame(versions, "header string, width int, places array<int>")
    lines = _lines(spark, paths).join(index.join(known, "header"), "file").where(F.col("value") != F.col("header"))
    widths = sorted({width for _, width, _ in versions})
    cells = {w: F.from_csv("value", ", ".join(f"c{i} string" for i in range(w)), LINE_OPTIONS) for w in widths}
    split = lines.select("places", computed_once(*[F.when(F.col("width") == w, cells[w]).alias(f"w{w}") for w in widths]))
    cut = F.coalesce(*[F.when(F.col(f"w{w}").isNotNull(), F.array(*[F.col(f"w{w}")[f"c{i}"] for i in range(w)])) for w in widths])
    rows = split.select("places", computed_once(cut.alias("cells")))
    return rows.select(*[F.get("cells", F.get("places", F.lit(place))).alias(name) for place, name in enumerate(needed)]), headless


def header_of(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", "true").csv(path).columns
