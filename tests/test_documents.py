"""Documents written by ``s9_load_documents``: how many files and objects, and what they hold."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from pulseframe.sources.oura import EXPORT
from pulseframe.verification import queries


def log(spark, rows, user):
    kinds = F.array(*[F.lit(kind) for kind in ("view", "signup", "click", "purchase", "error")])
    return spark.range(rows).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(1_900_000_000 + F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
        user.cast("long").alias("user_id"),
        F.element_at(kinds, (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 977).cast("double").alias("value"),
        F.format_string('{"k": %d}', F.lit(50)).alias("props"),
    )


def test_ring_files_follow_the_readings_not_users_times_rows(spark, tmp_path, monkeypatch):
    """200,000 rows of 300 users: the log's size alone cuts no user, and a file holds many users."""
    monkeypatch.setattr(queries, "scratch", lambda spark, label: str(tmp_path / label))
    log(spark, 200_000, F.col("id") % 300).write.parquet(str(tmp_path / "events.parquet"))
    found = queries.s9_load_documents(spark, str(tmp_path))
    assert found.where("source = 'oura'").agg(F.sum("n")).first()[0] == 200_000
    rings = tmp_path / "load-documents" / "oura.json"
    assert len(list(rings.rglob("*.txt"))) <= 12
    objects = spark.read.schema(EXPORT).option("multiLine", "true").json(str(rings))
    assert objects.count() == objects.select("user_id").distinct().count() == 300
    assert not [p for p in Path(tmp_path / "load-documents" / "takeout.json").iterdir() if p.is_dir()]


def test_only_large_users_are_cut_and_equal_rows_spread(spark):
    """25,000 equal readings without a user make three objects of about the same size; ten of one user make one."""
    day = "array(struct('2033-05-06' AS day, '60.0' AS total_sleep_duration, CAST(NULL AS STRING) AS hr_average, CAST(NULL AS STRING) AS hrv_average))"
    no_steps = "CAST(NULL AS ARRAY<STRUCT<day: STRING, steps: STRING, active_calories: STRING, active_duration: STRING>>)"
    rings = spark.range(25_010).selectExpr("IF(id < 10, 'o-1', NULL) AS user_id", f"{day} AS sleep", f"{no_steps} AS activity")
    objects = queries._ring_objects(rings).select("user_id", F.size(F.from_json("document", EXPORT).sleep).alias("n")).collect()
    assert [r.n for r in objects if r.user_id] == [10]
    sizes = [r.n for r in objects if r.user_id is None]
    assert len(sizes) == 3 and sum(sizes) == 25_000 and max(sizes) < 10_000
