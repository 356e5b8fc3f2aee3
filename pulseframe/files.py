"""Small files and folders on any file system that Spark can write."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    """(file system, path object, the ``org.apache.hadoop.fs`` package)"""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place, hadoop


def read_small_file(spark: SparkSession, path: str) -> str | None:
    """Text of a file; nothing if there is none."""
    files, place, _ = _file_system(spark, path)
    if not files.exists(place):
        return None
    return spark.read.text(path, wholetext=True).first().value


def replace_small_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a file beside the old one, then put it in its place in one step."""
    files, place, hadoop = _file_system(spark, path)
    new = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(new)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    options = spark._sc._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(files.makeQualified(place).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(new), files.makeQualified(place), options)


def delete_folders(spark: SparkSession, path: str, keep: set[str]) -> None:
    """Delete the folders below a path, but for those of these names."""
    files, place, _ = _file_system(spark, path)
    for found in files.listStatus(place):
        if found.isDirectory() and found.getPath().getName() not in keep:
            files.delete(found.getPath(), True)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    files, place, _ = _file_system(spark, path)
    files.delete(place, True)
