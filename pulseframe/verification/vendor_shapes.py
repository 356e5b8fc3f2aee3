"""The activity log projected into each vendor's row shape, every row of it.

``k`` is the number each log row carries in ``props``; it picks which optional fields a row lacks,
so defaults, bad values and dropped types all occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is(*kinds: str) -> Column:
    return F.col("event_type").isin(*kinds)


def _odd() -> Column:
    return F.pmod("event_id", F.lit(2)) == 1


def with_k(log: DataFrame) -> DataFrame:
    return log.withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))


def _clock(ts: Column, layout: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(ts, layout)


def _user(prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.col("user_id").cast("string"))


def apple_records(log: DataFrame) -> DataFrame:
    kind = (
        F.when(_is("view"), "HKQuantityTypeIdentifierStepCount")
        .when(_is("signup"), "HKCategoryTypeIdentifierSleepAnalysis")
        .when(_is("purchase"), "HKQuantityTypeIdentifierActiveEnergyBurned")
        .when(_is("error") & _odd(), "HKQuantityTypeIdentifierRestingHeartRate")
        .when(_is("error"), "HKQuantityTypeIdentifierHeartRateVariabilitySDNN")
        .when(F.col("k") < 50, "HKQuantityTypeIdentifierHeartRate")
        .otherwise("HKQuantityTypeIdentifierBodyMass")
    )
    value = F.when(F.col("k") >= 95, F.lit(None)).when(F.col("k") < 90, F.col("value").cast("string")).otherwise("not available")
    minutes = F.when(F.col("k") >= 95, -F.col("k")).otherwise(F.col("k"))
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return with_k(log).select(
        kind.alias("_type"),
        F.when(F.col("k") >= 5, _user("phone-")).alias("_sourceName"),
        F.when(F.col("k") >= 50, _user("watch-")).alias("_device"),
        F.when(F.col("k") >= 30, "given").alias("_unit"),
        value.alias("_value"),
        F.concat(_clock(F.col("ts")), F.lit(" +0200")).alias("_startDate"),
        F.when(F.col("k") >= 10, F.concat(_clock(end), F.lit(" +0200"))).alias("_endDate"),
    )


def xml_lines(records: DataFrame) -> DataFrame:
    """Lines of an export: a tag per record, a tenth of them in a group as well."""
    attributes = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'{c[1:]}="'), F.col(c), F.lit('"'))) for c in records.columns]
    tag = F.concat(F.lit("<Record "), F.concat_ws(" ", *attributes), F.lit("/>"))
    grouped = F.concat(F.lit('<Correlation type="group">'), tag, F.lit("</Correlation>"), tag)
    return records.select(F.when(F.pmod(F.xxhash64("*"), F.lit(10)) == 0, grouped).otherwise(tag).alias("value"))


def _cell(kind: str) -> Column:
    return F.when(_is(kind), F.col("value").cast("string"))


def fitbit_activity(log: DataFrame) -> DataFrame:
    return log.select(
        _user().alias("Id"),
        _clock(F.col("ts"), "M/d/yyyy").alias("ActivityDate"),
        _cell("view").alias("TotalSteps"),
        _cell("purchase").alias("Calories"),
        _cell("click").alias("VeryActiveMinutes"),
        F.coalesce(_cell("error"), F.lit("NA")).alias("FairlyActiveMinutes"),
        _cell("signup").alias("SedentaryMinutes"),
    )


def fitbit_sleep(log: DataFrame) -> DataFrame:
    return log.select(
        _user().alias("Id"),
        _clock(F.col("ts"), "M/d/yyyy h:mm:ss a").alias("SleepDay"),
        _cell("signup").alias("TotalMinutesAsleep"),
        F.col("value").cast("string").alias("TotalTimeInBed"),
    )


def google_points(log: DataFrame) -> DataFrame:
    k, text = F.col("k"), F.col("value").cast("string")
    kind = (
        F.when(_is("view"), "com.google.step_count.delta")
        .when(_is("signup"), "com.google.heart_minutes")
        .when(_is("purchase"), "com.google.calories.expended")
        .when(_is("error") & _odd(), "com.google.resting_heart_rate.bpm")
        .when(_is("error"), "com.google.hrv")
        .when(k < 50, "com.google.heart_rate.bpm")
        .otherwise("com.google.weight")
    )
    whole = F.floor("value").cast("string")
    no_text = F.lit(None).cast("string")
    no_map = F.lit(None).cast("array<struct<value: struct<fpVal: string>>>")
    in_map = F.array(F.struct(F.struct(text.alias("fpVal")).alias("value")))

    def fit(int_val: Column, fp_val: Column, map_val: Column) -> Column:
        return F.array(F.struct(int_val.alias("intVal"), fp_val.alias("fpVal"), map_val.alias("mapVal")))

    fit_value = (
        F.when(k < 25, fit(whole, text, no_map))
        .when(k < 50, fit(whole, F.lit("0"), no_map))
        .when(k < 75, fit(F.lit("0"), no_text, in_map))
    )
    nanos = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) * F.lit(1000)
    return with_k(log).select(
        F.when(k < 40, kind).otherwise("").alias("dataTypeName"),
        kind.alias("metric"),
        F.when(k >= 5, _user("g-")).alias("originDataSourceId"),
        nanos.cast("string").alias("startTimeNanos"),
        F.when(k >= 30, "given").alias("unit"),
        F.when(k < 95, text).alias("value"),
        fit_value.alias("fitValue"),
    )


def oura_documents(log: DataFrame) -> DataFrame:
    day = _clock(F.col("ts"), "yyyy-MM-dd").alias("day")
    seconds = (F.col("value") * F.lit(60.0)).cast("string")
    text, none = F.col("value").cast("string"), F.lit(None).cast("string")
    sleep = F.struct(
        day,
        F.when(_is("signup"), seconds).otherwise(none).alias("total_sleep_duration"),
        F.when(_is("error") & _odd(), text).otherwise(none).alias("hr_average"),
        F.when(_is("error") & ~_odd(), text).otherwise(none).alias("hrv_average"),
    )
    activity = F.struct(
        day,
        F.when(_is("view"), text).otherwise(none).alias("steps"),
        F.when(_is("purchase"), text).otherwise(none).alias("active_calories"),
        F.when(_is("click"), seconds).otherwise(none).alias("active_duration"),
    )
    return with_k(log).select(
        F.when(F.col("k") >= 5, _user("o-")).alias("user_id"),
        F.when(_is("signup", "error"), F.array(sleep)).alias("sleep"),
        F.when(_is("view", "purchase", "click"), F.array(activity)).alias("activity"),
    )


def garmin_messages(log: DataFrame) -> DataFrame:
    return with_k(log).select(
        F.lit("record").alias("message_name"),
        F.when(F.col("k") >= 5, F.col("ts")).alias("timestamp"),
        F.when(_is("view"), F.col("value")).alias("steps"),
        F.when(_is("purchase"), F.col("value")).alias("calories"),
        F.when(_is("click", "signup"), F.col("value")).alias("heart_rate"),
        F.when(_is("error", "signup"), F.col("value")).alias("resting_heart_rate"),
        F.when(F.col("k") >= 50, _user("m-")).alias("user_profile_index"),
    )


def manual_rows(log: DataFrame) -> DataFrame:
    k = F.col("k")
    stamp = F.when(k < 20, _clock(F.col("ts"), "yyyy-MM-dd")).when(k < 98, _clock(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return with_k(log).select(
        stamp.alias(" Date "),
        F.col("event_type").alias("Metric"),
        F.when(k < 90, F.col("value").cast("string")).when(k < 95, "1e2").otherwise("many").alias("VALUE"),
        F.when(k >= 30, "given").when(k >= 10, "NA").alias("Unit"),
        F.when(k >= 50, _user("u-")).alias("user_id"),
    )


def canonical_csv_rows(events: DataFrame) -> DataFrame:
    """Canonical events as hand-kept CSV text."""
    return events.select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "metric",
        F.col("value").cast("string").alias("value"),
        "unit",
        "source",
        "source_user_id",
    )


def upload_paths(log: DataFrame) -> DataFrame:
    """One file name per log row, in a folder per user and day."""
    k = F.col("k")
    name = (
        F.when(_is("view"), F.when(k < 20, "dailyActivity_merged.csv").otherwise("notes.csv"))
        .when(_is("signup"), F.when(k < 50, "my_oura_data.json").otherwise("Takeout.json"))
        .when(_is("purchase"), F.when(k < 10, "sleepDay_merged.csv").otherwise("ride.FIT"))
        .when(_is("click"), F.when(k < 10, "export.xml").otherwise("zebra.txt"))
        .otherwise("metrics.csv")
    )
    folder = F.concat_ws("/", F.lit("uploads"), F.col("user_id").cast("string"), _clock(F.col("ts"), "yyyy-MM-dd"))
    return with_k(log).select(F.concat_ws("/", folder, name).alias("path"))
