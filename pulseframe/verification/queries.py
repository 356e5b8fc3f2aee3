"""One query per operator, each over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.functions import (
    any_anomaly,
    float_text,
    health_score,
    iso_clock,
    number,
    python_round,
    score_band,
    sleep_split,
    trend_arrow,
    us_clock,
)
from pulseframe.functions.clock import clock_minutes, epoch_nanos, offset_clock
from pulseframe.operators import (
    correlation_matrix,
    correlation_pairs,
    daily_overview,
    daily_reduce,
    daily_wide,
    heatmap,
    latest_user,
    newest_days,
    pair_rank,
    pair_samples,
    pivot_daily,
    rolling_zscore,
    search_pairs,
    top_pairs,
    users,
)
from pulseframe.operators.correlation import at_lag, matrix_wide, pair_names, with_next_row
from pulseframe.operators.rolling import rolling_stats
from pulseframe.plans import (
    EventStore,
    IncrementalTables,
    chat_context,
    correlation_payload,
    dataset_profile,
    insight_payload,
    latest_day,
    overview_payload,
    recent_anomalies,
    report_rows,
    select_user,
    trend_slice,
    user_stats,
)
from pulseframe.plans.read_models import pair_list
from pulseframe.plans.report import flag_text, pair_label
from pulseframe.plans.store import load_sample_overview
from pulseframe.schema import ANOMALY_FLAGS, CORRELATED_METRICS, EVENT_COLUMNS, ROLLING_METRICS, TREND_METRICS, USER, WIDE_METRICS
from pulseframe.session import scratch
from pulseframe.sources import accepted, activity_events, classify_uploads, load_events, rejected
from pulseframe.sources.apple import apple_events, read_apple
from pulseframe.sources.canonical import computed_once
from pulseframe.sources.fitbit import activity_events as fitbit_activity_events
from pulseframe.sources.fitbit import sleep_events as fitbit_sleep_events
from pulseframe.sources.garmin import garmin_events
from pulseframe.sources.google import google_events
from pulseframe.sources.manual import manual_events, normalize_headers
from pulseframe.sources.oura import oura_events
from pulseframe.streaming import import_new_files
from pulseframe.verification import vendor_shapes as shapes

Query = Callable[[SparkSession, str], DataFrame]


def places(*names: str, digits: int = 6) -> dict[str, Column]:
    return {name: F.round(name, digits) for name in names}


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return activity_events(_log(spark, folder))


def _overview(spark: SparkSession, folder: str) -> DataFrame:
    return daily_overview(_events(spark, folder))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return correlation_pairs(_overview(spark, folder))


SCORES = ("steps_zscore", "sleep_zscore", "resting_hr_zscore", "hrv_zscore")


def _rounded_overview(overview: DataFrame) -> DataFrame:
    return overview.withColumns(places(*CORRELATED_METRICS, *SCORES))


# ---- sources -------------------------------------------------------------------------------


def _rows(shape: Callable[[DataFrame], DataFrame], spark: SparkSession, folder: str) -> DataFrame:
    """Vendor rows as a scan would deliver them, shaped once and not anew in each parsing expression."""
    return shape(_log(spark, folder)).select(computed_once(F.col("*")))


def _with_metadata(events: DataFrame, *keys: str) -> DataFrame:
    fields = [F.get_json_object("metadata_json", f"$.{key}").alias(key) for key in keys]
    return events.select(USER, "timestamp", "metric", F.round("value", 6).alias("value"), "unit", "source", *fields)


def s1_apple(spark: SparkSession, folder: str) -> DataFrame:
    return _with_metadata(accepted(apple_events(_rows(shapes.apple_records, spark, folder))), "record_type", "source_name")


def s1_apple_files(spark: SparkSession, folder: str) -> DataFrame:
    """Exports written as XML, each tenth record once more inside a group, read back in splits."""
    records = _rows(shapes.apple_records, spark, folder)
    path = f"{scratch(spark, 'xml')}/exports"
    shapes.xml_lines(records).write.text(path)
    return _with_metadata(accepted(apple_events(read_apple(spark, [path]))), "record_type", "source_name")


def s1_apple_asleep(spark: SparkSession, folder: str) -> DataFrame:
    """Only sleep that is marked as such; here watches tell it apart and phones record time in bed."""
    records = _rows(shapes.apple_records, spark, folder)
    stage = F.when(F.col("_device").isNull(), "HKCategoryValueSleepAnalysisInBed").otherwise("HKCategoryValueSleepAnalysisAsleepCore")
    sleep = F.col("_type") == "HKCategoryTypeIdentifierSleepAnalysis"
    records = records.withColumn("_value", F.when(sleep, stage).otherwise(F.col("_value")))
    return _with_metadata(accepted(apple_events(records, asleep_only=True)), "record_type", "source_name")


def s2_fitbit_activity(spark: SparkSession, folder: str) -> DataFrame:
    return _with_metadata(accepted(fitbit_activity_events(_rows(shapes.fitbit_activity, spark, folder))), "column")


def s3_fitbit_sleep(spark: SparkSession, folder: str) -> DataFrame:
    return _with_metadata(accepted(fitbit_sleep_events(_rows(shapes.fitbit_sleep, spark, folder))), "column")


def s4_google(spark: SparkSession, folder: str) -> DataFrame:
    return _with_metadata(accepted(google_events(_rows(shapes.google_points, spark, folder))), "data_type_name")


def s5_oura(spark: SparkSession, folder: str) -> DataFrame:
    return _with_metadata(accepted(oura_events(_rows(shapes.oura_documents, spark, folder))), "section", "field")


def s6_garmin(spark: SparkSession, folder: str) -> DataFrame:
    return _with_metadata(accepted(garmin_events(_rows(shapes.garmin_messages, spark, folder))), "message_name", "field")


def s7_manual(spark: SparkSession, folder: str) -> DataFrame:
    return _with_metadata(accepted(manual_events(_rows(shapes.manual_rows, spark, folder))), "input")


def s7_manual_rejected(spark: SparkSession, folder: str) -> DataFrame:
    bad = rejected(manual_events(_rows(shapes.manual_rows, spark, folder)))
    return bad.groupBy("metric", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


def s8_infer_source(spark: SparkSession, folder: str) -> DataFrame:
    return classify_uploads(shapes.upload_paths(_log(spark, folder)))


def _written_csv(frame: DataFrame, path: str) -> str:
    frame.write.option("header", "true").csv(path)
    return path


def s9_load_files(spark: SparkSession, folder: str) -> DataFrame:
    """Vendor files written from the log, then read back through the loader of each source."""
    root, log = scratch(spark, "load-files"), _log(spark, folder)
    tracker = [
        _written_csv(shapes.fitbit_activity(log), f"{root}/tracker/dailyActivity_merged.csv"),
        _written_csv(shapes.fitbit_sleep(log), f"{root}/tracker/sleepDay_merged.csv"),
    ]
    manual = _written_csv(shapes.manual_rows(log), f"{root}/metrics.csv")
    xml = f"{root}/export.xml"
    shapes.apple_records(log).write.format("xml").option("rootTag", "HealthData").option("rowTag", "Record").save(xml)
    loaded = load_events(spark, tracker).unionByName(load_events(spark, [manual])).unionByName(load_events(spark, [xml]))
    return loaded.groupBy("source", "metric", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(USER).alias("users"), F.round(F.sum("value"), 4).alias("total")
    )


def _written_documents(documents: DataFrame, path: str) -> str:
    """One JSON document a file, from column ``document``, all files in one folder."""
    documents.select("document").write.option("maxRecordsPerFile", 1).text(path)
    return path


#: Readings of a ring object, at most about, and of all objects in a file.
_OF_RING, _OF_FILE = 10_000, 20_000


def _ring_objects(rings: DataFrame) -> DataFrame:
    """One object a user, column ``document``, and the user's readings as ``readings``; only users of more than ``_OF_RING`` readings have several."""
    pieces = F.floor(F.count(F.lit(1)) / _OF_RING) + 1
    large = rings.groupBy(F.col("user_id").alias("large_id")).agg(pieces.alias("pieces")).where(F.col("pieces") > 1)
    dealt = rings.withColumn("place", F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.join(large, F.col("user_id").eqNullSafe(F.col("large_id")), "left")
    n = F.pmod("place", F.coalesce("pieces", F.lit(1)))
    sections = [F.flatten(F.collect_list(name)).alias(name) for name in ("sleep", "activity")]
    users = dealt.groupBy("user_id", n.alias("n")).agg(*sections)
    return users.select("user_id", "n", F.to_json(F.struct("user_id", "sleep", "activity")).alias("document"))


def s9_load_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Takeout lists of some 500 points, ring objects of a user's readings and watch messages written from the log, then read back through the
    loader of each source. Ring objects are many and small, so a file holds an array of them; a list of points is a file."""
    root, log = scratch(spark, "load-documents"), _log(spark, folder)
    rows = log.count()
    points = shapes.google_points(log)
    part = F.pmod(F.xxhash64(*points.columns), F.lit(rows // 500 + 1))
    lists = points.groupBy(part.alias("part")).agg(F.to_json(F.collect_list(F.struct("*"))).alias("document"))
    users = _ring_objects(shapes.oura_documents(log))
    file = F.pmod(F.xxhash64("user_id", "n"), F.lit(rows // _OF_FILE + 1))
    arrays = users.groupBy(file.alias("file")).agg(F.concat(F.lit("["), F.concat_ws(",\n", F.collect_list("document")), F.lit("]")).alias("document"))
    paths = [_written_documents(lists, f"{root}/takeout.json"), _written_documents(arrays, f"{root}/oura.json"), f"{root}/ride.fit"]
    shapes.garmin_messages(log).write.json(paths[2])
    loaders = zip(paths, ("google_health", "oura", "garmin"), strict=True)
    loaded = reduce(DataFrame.unionByName, [load_events(spark, [path], source) for path, source in loaders])
    return loaded.groupBy("source", "metric", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(USER).alias("users"), F.round(F.sum("value"), 4).alias("total")
    )


def s10_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Sample files into an empty store; a second call finds events and adds nothing."""
    root, log = scratch(spark, "bootstrap"), _log(spark, folder)
    _written_csv(shapes.fitbit_sleep(log), f"{root}/raw/sleepDay_merged.csv")
    store = EventStore(spark, f"{root}/store")
    store.bootstrap_sample(f"{root}/raw")
    store.bootstrap_sample(f"{root}/raw")
    return store.import_runs().select("source", F.col("record_count"), F.col("user_count"))


def s11_load_data(spark: SparkSession, folder: str) -> DataFrame:
    root, log = scratch(spark, "load-data"), _log(spark, folder)
    _written_csv(shapes.fitbit_activity(log), f"{root}/raw/dailyActivity_merged.csv")
    _written_csv(shapes.fitbit_sleep(log), f"{root}/raw/sleepDay_merged.csv")
    overview = load_sample_overview(spark, f"{root}/raw", f"{root}/store")
    return _rounded_overview(overview).select(USER, "day", "steps", "sleep_minutes", "calories", "health_score", "steps_zscore")


# ---- scans and sinks -----------------------------------------------------------------------


def _filled_store(spark: SparkSession, folder: str, refresh: bool = False) -> EventStore:
    store = EventStore(spark, scratch(spark, "store"))
    store.append_events(_events(spark, folder), "activity_log", 1)
    if refresh:
        store.refresh()
    return store


def k1_append_events(spark: SparkSession, folder: str) -> DataFrame:
    return _filled_store(spark, folder).raw_events().select(*EVENT_COLUMNS).withColumns(places("value"))


def k2_import_audit(spark: SparkSession, folder: str) -> DataFrame:
    store = _filled_store(spark, folder)
    store.append_events(_events(spark, folder).where(F.col("metric") == "hrv"), "second_log", 2)
    return store.import_runs().select("source", "file_count", "record_count", "user_count")


def _compacted_store(spark: SparkSession, folder: str) -> EventStore:
    """The log in six imports by hour, merged after the fourth and, generations included, after the sixth."""
    store, events = EventStore(spark, scratch(spark, "compacted")), _events(spark, folder)
    for part in range(6):
        store.append_events(events.where(F.hour("timestamp") % 6 == part), f"log_{part}", 1)
        if part in (3, 5):
            store.compact(most_generations=1)
    return store


def k1_compacted_events(spark: SparkSession, folder: str) -> DataFrame:
    return _compacted_store(spark, folder).raw_events().select(*EVENT_COLUMNS).withColumns(places("value"))


def k2_compacted_audit(spark: SparkSession, folder: str) -> DataFrame:
    return _compacted_store(spark, folder).import_runs().select("source", "file_count", "record_count", "user_count")


def k3_replace_overview(spark: SparkSession, folder: str) -> DataFrame:
    store = _filled_store(spark, folder)
    overview = daily_overview(store.raw_events())
    store.replace_overview(overview)
    store.replace_overview(overview)
    return _rounded_overview(store.overview()).drop("updated_at")


def k4_replace_pairs(spark: SparkSession, folder: str) -> DataFrame:
    store = _filled_store(spark, folder)
    store.replace_overview(daily_overview(store.raw_events()))
    pairs = correlation_pairs(store.overview())
    store.replace_pairs(pairs)
    store.replace_pairs(pairs)
    return store.pairs().drop("updated_at").withColumns(places("correlation"))


def k5_scan_events(spark: SparkSession, folder: str) -> DataFrame:
    return _filled_store(spark, folder).raw_events("7").select(*EVENT_COLUMNS).withColumns(places("value"))


def k6_scan_overview(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_overview(_filled_store(spark, folder, refresh=True).overview("7")).drop("updated_at")


def k7_scan_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _filled_store(spark, folder, refresh=True).pairs("7", lag_days=1)
    return pairs.drop("updated_at").withColumns(places("correlation"))


# ---- projections and filters ---------------------------------------------------------------


def f1_metric_map(spark: SparkSession, folder: str) -> DataFrame:
    mapped = apple_events(_rows(shapes.apple_records, spark, folder))
    kind = F.get_json_object("metadata_json", "$.record_type")
    return mapped.groupBy(kind.alias("record_type"), "metric").agg(F.count(F.lit(1)).alias("n"))


def f2_event_day(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def f3_absent_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Two metrics only: the other wide columns exist and are null."""
    return daily_wide(_events(spark, folder).where(F.col("metric").isin("steps", "hrv"))).withColumns(places(*WIDE_METRICS))


def f4_select_user(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_overview(select_user(_overview(spark, folder), _events(spark, folder)))


def f5_overview(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_overview(_overview(spark, folder))


def f6_any_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    return _overview(spark, folder).where(any_anomaly()).select(USER, "day", *ANOMALY_FLAGS)


def f7_lag_filter(spark: SparkSession, folder: str) -> DataFrame:
    return at_lag(_pairs(spark, folder), 1).withColumns(places("correlation"))


def f8_sample_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Complete samples per pair before the minimum-size rule, with how many pairs pass it."""
    sizes = pair_samples(_overview(spark, folder)).groupBy(USER, "pair").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.groupBy("pair").agg(
        F.count(F.lit(1)).alias("users"), F.count_if(F.col("n") >= 3).alias("kept"), F.sum("n").alias("samples")
    )
    return totals.select(*pair_names(), "users", "kept", "samples")


def f9_pair_search(spark: SparkSession, folder: str) -> DataFrame:
    return search_pairs(_pairs(spark, folder), "STEPS h").withColumns(places("correlation"))


# ---- aggregations --------------------------------------------------------------------------


def a1_daily_reduce(spark: SparkSession, folder: str) -> DataFrame:
    return daily_reduce(_events(spark, folder)).withColumns(places("value"))


def a2_daily_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return daily_wide(_events(spark, folder)).withColumns(places(*WIDE_METRICS))


def a2_pivot_reduced(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_daily(daily_reduce(_events(spark, folder))).withColumns(places(*WIDE_METRICS))


def a3_correlation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).withColumns(places("correlation"))


def a4_sample_size(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).groupBy("metric_a", "metric_b", "lag_days").agg(
        F.count(F.lit(1)).alias("users"), F.sum("sample_size").alias("samples"), F.max("sample_size").alias("largest")
    )


def a5_event_count(spark: SparkSession, folder: str) -> DataFrame:
    n = F.count(F.lit(1))
    return _events(spark, folder).agg(n.alias("n"), (n > 0).alias("has_events"))


def a6_users(spark: SparkSession, folder: str) -> DataFrame:
    return users(_events(spark, folder))


def a7_import_users(spark: SparkSession, folder: str) -> DataFrame:
    store = _filled_store(spark, folder)
    store.append_events(_events(spark, folder).where(F.col("metric") == "hrv"), "second_log", 2)
    named = store.import_users().join(store.import_runs().select("import_id", "source"), "import_id")
    return named.select("source", USER)


def a8_recent_means(spark: SparkSession, folder: str) -> DataFrame:
    return user_stats(_overview(spark, folder)).select(USER, "steps_7d_avg", "sleep_7d_avg")


def a9_correlation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return correlation_matrix(_pairs(spark, folder))


def a9_matrix_wide(spark: SparkSession, folder: str) -> DataFrame:
    return matrix_wide(_pairs(spark, folder))


def a10_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    return heatmap(_pairs(spark, folder))


def a11_profile(spark: SparkSession, folder: str) -> DataFrame:
    return dataset_profile(_overview(spark, folder))


# ---- windows -------------------------------------------------------------------------------


def _rolling(spark: SparkSession, folder: str, pick: int, name: str) -> DataFrame:
    columns = [F.round(rolling_stats(metric)[pick], 6).alias(f"{metric}_{name}") for metric in ROLLING_METRICS]
    return daily_wide(_events(spark, folder)).select(USER, "day", *columns)


def w1_rolling_mean(spark: SparkSession, folder: str) -> DataFrame:
    return _rolling(spark, folder, 0, "mean")


def w2_rolling_std(spark: SparkSession, folder: str) -> DataFrame:
    return _rolling(spark, folder, 1, "std")


def w3_rolling_zscore(spark: SparkSession, folder: str) -> DataFrame:
    names = [f"{metric}_zscore" for metric in ROLLING_METRICS]
    return rolling_zscore(daily_wide(_events(spark, folder)), ROLLING_METRICS).select(USER, "day", *names).withColumns(places(*names))


def w4_next_row(spark: SparkSession, folder: str) -> DataFrame:
    names = [f"next_{metric}" for metric in CORRELATED_METRICS]
    return with_next_row(_overview(spark, folder)).select(USER, "day", *names).withColumns(places(*names))


def w5_trend_slice(spark: SparkSession, folder: str) -> DataFrame:
    return trend_slice(_overview(spark, folder)).withColumns(places(*TREND_METRICS))


def w6_recent_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return recent_anomalies(_overview(spark, folder))


def w7_last_seven(spark: SparkSession, folder: str) -> DataFrame:
    recent = newest_days(_overview(spark, folder), 7)
    return recent.select(USER, "day", F.col("recency"), "steps", "sleep_minutes").withColumns(places("steps", "sleep_minutes"))


def w8_latest_day(spark: SparkSession, folder: str) -> DataFrame:
    return latest_day(_overview(spark, folder)).withColumns(places("steps", "sleep_minutes", "resting_hr", "hrv"))


# ---- order and top-k -----------------------------------------------------------------------


def o1_latest_user(spark: SparkSession, folder: str) -> DataFrame:
    return latest_user(_events(spark, folder))


def o2_user_day_order(spark: SparkSession, folder: str) -> DataFrame:
    """Overview in user and day order, each row with its place in the user's history."""
    place = F.row_number().over(Window.partitionBy(USER).orderBy("day"))
    return _overview(spark, folder).select(USER, "day", place.alias("place")).orderBy(USER, "day")


def o3_pair_order(spark: SparkSession, folder: str) -> DataFrame:
    return pair_rank(_pairs(spark, folder)).withColumns(places("correlation"))


def o4_top_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return top_pairs(_pairs(spark, folder), 5).withColumns(places("correlation"))


def o5_last_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(USER).orderBy(F.col("day").desc()))
    flagged = recent_anomalies(_overview(spark, folder)).withColumn("place", place)
    return flagged.where(F.col("place") <= 5).select(USER, "day", "place", flag_text_row().alias("labels"))


def flag_text_row() -> Column:
    return flag_text(F.struct("low_sleep", "low_activity", "high_resting_hr"))


def u1_union_sources(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        apple_events(_rows(shapes.apple_records, spark, folder)),
        fitbit_activity_events(_rows(shapes.fitbit_activity, spark, folder)),
        fitbit_sleep_events(_rows(shapes.fitbit_sleep, spark, folder)),
        google_events(_rows(shapes.google_points, spark, folder)),
        oura_events(_rows(shapes.oura_documents, spark, folder)),
        garmin_events(_rows(shapes.garmin_messages, spark, folder)),
        manual_events(_rows(shapes.manual_rows, spark, folder)),
    ]
    merged = accepted(parts[0])
    for part in parts[1:]:
        merged = merged.unionByName(accepted(part))
    return merged.groupBy("source", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# ---- scalar functions ----------------------------------------------------------------------


def c1_health_score(spark: SparkSession, folder: str) -> DataFrame:
    score = health_score(F.col("steps"), F.col("sleep_minutes"), F.col("active_minutes"))
    return daily_wide(_events(spark, folder)).select(USER, "day", F.round(score, 6).alias("health_score"))


def c2_anomaly_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _overview(spark, folder).select(USER, "day", *ANOMALY_FLAGS)


def c3_steps_trend(spark: SparkSession, folder: str) -> DataFrame:
    return user_stats(_overview(spark, folder)).select(USER, "steps", "steps_trend")


def c4_user_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = user_stats(_overview(spark, folder)).withColumns(places("resting_hr", "hrv"))
    return stats.select("*", "anomalies.*").drop("anomalies")


INSIGHT_DDL = (
    "date string, metrics struct<steps: bigint, sleep_minutes: bigint, health_score: double, resting_hr: double, hrv: double>, "
    "trends struct<steps_trend: string, avg_sleep_7d: bigint>, "
    "anomalies struct<low_sleep: boolean, low_activity: boolean, high_resting_hr: boolean>, "
    "correlations array<struct<metric_a: string, metric_b: string, lag_days: int, correlation: double, sample_size: int>>"
)


def _parsed_insight(payload: DataFrame) -> DataFrame:
    parsed = payload.select(USER, F.from_json("payload", INSIGHT_DDL).alias("p"))
    flat = parsed.select(USER, "p.date", "p.metrics.*", "p.trends.*", "p.anomalies.*", F.col("p.correlations"))
    return flat.withColumns(places("resting_hr", "hrv"))


def c5_insight_json(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed_insight(insight_payload(_overview(spark, folder))).drop("correlations")


def c6_report_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Latest metrics as text, missing ones as n/a, and the latest day's flags by name."""
    rows = newest_days(_overview(spark, folder), 1)
    text = {name: F.coalesce(float_text(F.round(name, 3)), F.lit("n/a")) for name in ("steps", "sleep_minutes", "resting_hr", "hrv")}
    flags = F.struct(*[F.col(flag).alias(flag.removeprefix("anomaly_")) for flag in ANOMALY_FLAGS])
    return rows.select(USER, *[column.alias(name) for name, column in text.items()], flag_text(flags).alias("labels"))


def c6_pair_labels(spark: SparkSession, folder: str) -> DataFrame:
    pair = F.struct("metric_a", "metric_b", "lag_days")
    return _pairs(spark, folder).groupBy(pair_label(pair).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def c7_null_safe(spark: SparkSession, folder: str) -> DataFrame:
    wide = daily_wide(_events(spark, folder))
    return wide.agg(
        *[F.count_if(F.col(name).isNull()).alias(f"{name}_missing") for name in WIDE_METRICS],
        *[F.round(F.sum(F.coalesce(name, F.lit(0.0))), 3).alias(f"{name}_total") for name in WIDE_METRICS],
    )


def c8_rounding(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("value")
    return _log(spark, folder).select(
        "event_id", *[python_round(value / F.lit(8.0), digits).alias(f"round_{digits}") for digits in (1, 2, 3)]
    )


def c9_date_parsing(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.col("ts")

    def text(layout: str, tail: str = "") -> Column:
        return F.concat(F.date_format(ts, layout), F.lit(tail))

    nanos = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts) * F.lit(1000) + F.lit(700)
    return _log(spark, folder).select(
        "event_id",
        offset_clock(text("yyyy-MM-dd HH:mm:ss", " -0530")).alias("with_offset"),
        offset_clock(text("yyyy-MM-dd HH:mm:ss")).alias("without_offset"),
        us_clock(text("M/d/yyyy h:mm:ss a")).alias("us_time"),
        us_clock(text("M/d/yyyy")).alias("us_day"),
        iso_clock(text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("iso"),
        epoch_nanos(nanos.cast("string")).alias("from_nanos"),
        iso_clock(F.col("event_type")).isNull().alias("bad_is_null"),
    )


def c10_durations(spark: SparkSession, folder: str) -> DataFrame:
    start = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    later = F.date_format(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int")), "yyyy-MM-dd HH:mm:ss")
    return _log(spark, folder).select(
        "event_id",
        F.round(clock_minutes(F.concat(start, F.lit(" +0000")), F.concat(later, F.lit(" +0000"))), 6).alias("same_zone"),
        F.round(clock_minutes(F.concat(start, F.lit(" +0200")), F.concat(later, F.lit(" +0100"))), 6).alias("zone_change"),
        F.round(clock_minutes(later, start), 6).alias("backwards"),
        F.round(number(F.col("value").cast("string")) / F.lit(60.0), 6).alias("from_seconds"),
    )


def c11_metadata_json(spark: SparkSession, folder: str) -> DataFrame:
    parsed = accepted(oura_events(_rows(shapes.oura_documents, spark, folder)))
    return parsed.groupBy("metadata_json").agg(F.count(F.lit(1)).alias("n"))


def c12_headers(spark: SparkSession, folder: str) -> DataFrame:
    rows = normalize_headers(shapes.manual_rows(_log(spark, folder)))
    return rows.groupBy("metric").agg(
        F.count("timestamp").alias("timestamps"), F.count("value").alias("values"), F.count("unit").alias("units"), F.count(USER).alias("users")
    )


def c13_bands(spark: SparkSession, folder: str) -> DataFrame:
    stats = user_stats(_overview(spark, folder))
    hours, minutes = sleep_split(F.col("sleep_minutes"))
    return stats.select(
        USER,
        score_band(F.col("health_score")).alias("band"),
        hours.alias("sleep_hours"),
        minutes.alias("sleep_rest"),
        trend_arrow(F.col("steps_trend")).alias("arrow"),
    )


# ---- read models ---------------------------------------------------------------------------


def r1_overview(spark: SparkSession, folder: str) -> DataFrame:
    """The nested payload unfolded: one row per user and trend day with the user's latest values."""
    payload = overview_payload(_overview(spark, folder), users(_events(spark, folder)))
    days = payload.select(
        USER,
        F.col("latest.day").alias("latest_day"),
        F.col("latest.health_score").alias("latest_score"),
        F.size("trend_slices").alias("trend_days"),
        F.size("anomalies").alias("anomaly_days"),
        F.posexplode("trend_slices").alias("position", "t"),
    )
    return days.select("*", "t.*").drop("t").withColumns(places(*TREND_METRICS))


def r2_correlations(spark: SparkSession, folder: str) -> DataFrame:
    """The nested payload unfolded: each ranked pair with its two matrix cells."""
    payload = correlation_payload(_pairs(spark, folder))
    rows = payload.select(USER, "matrix", F.inline("pairs"))

    def cell(first: str, second: str) -> Column:
        return F.try_element_at(F.try_element_at("matrix", F.col(first)), F.col(second))

    return rows.select("*", cell("metric_a", "metric_b").alias("cell"), cell("metric_b", "metric_a").alias("mirror")).drop("matrix")


def r2_pair_list(spark: SparkSession, folder: str) -> DataFrame:
    return pair_list(_pairs(spark, folder), 1)


def r3_narrative(spark: SparkSession, folder: str) -> DataFrame:
    overview = _overview(spark, folder)
    parsed = _parsed_insight(insight_payload(overview, correlation_pairs(overview)))
    return parsed.select(USER, "date", "steps", "steps_trend", "avg_sleep_7d", F.posexplode_outer("correlations").alias("position", "c")).select(
        "*", "c.*"
    ).drop("c")


CHAT_DDL = (
    "overview struct<latest: struct<day: string, steps: double, health_score: double>, "
    "trend_slices: array<struct<day: string, health_score: double>>, anomalies: array<struct<day: string>>>, "
    "correlations array<struct<metric_a: string, metric_b: string, lag_days: int, correlation: double, sample_size: int>>"
)


def r3_chat_context(spark: SparkSession, folder: str) -> DataFrame:
    overview = _overview(spark, folder)
    context = chat_context(overview, correlation_pairs(overview))
    parsed = context.select(USER, F.from_json("payload", CHAT_DDL).alias("p"))
    return parsed.select(
        USER,
        F.col("p.overview.latest.day").alias("latest_day"),
        F.round("p.overview.latest.steps", 6).alias("latest_steps"),
        F.col("p.overview.latest.health_score").alias("latest_score"),
        F.size("p.overview.trend_slices").alias("trend_days"),
        F.size("p.overview.anomalies").alias("anomaly_days"),
        F.size("p.correlations").alias("pair_count"),
        F.try_element_at("p.correlations", F.lit(1))["metric_a"].alias("strongest_a"),
        F.try_element_at("p.correlations", F.lit(1))["correlation"].alias("strongest"),
    )


def r4_report(spark: SparkSession, folder: str) -> DataFrame:
    overview = _overview(spark, folder)
    return report_rows(overview, correlation_pairs(overview))


# ---- jobs ----------------------------------------------------------------------------------


def t1_incremental_import(spark: SparkSession, folder: str) -> DataFrame:
    """Two deliveries of CSV files picked up by the stream, the second after the first is done."""
    root, events = scratch(spark, "incremental"), _events(spark, folder)
    store = EventStore(spark, f"{root}/store")
    first = F.col("metric").isin("steps", "sleep_minutes")
    for name, part in (("first.csv", events.where(first)), ("second.csv", events.where(~first))):
        _written_csv(shapes.canonical_csv_rows(part), f"{root}/landing/{name}")
        import_new_files(spark, f"{root}/landing", store, f"{root}/checkpoint")
    return _rounded_overview(store.overview()).drop("updated_at")


def t2_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Import the log in two parts, refresh, and summarise both derived tables."""
    store, events = EventStore(spark, scratch(spark, "refresh")), _events(spark, folder)
    morning = F.hour("timestamp") < 12
    store.append_events(events.where(morning), "activity_log", 1)
    store.append_events(events.where(~morning), "activity_log", 1)
    store.refresh()
    days = store.overview().groupBy(USER).agg(
        F.count(F.lit(1)).alias("days"), F.round(F.sum("health_score"), 6).alias("score"), F.count_if(any_anomaly()).alias("anomalies")
    )
    pairs = store.pairs().groupBy(USER).agg(F.count(F.lit(1)).alias("pairs"), F.sum("sample_size").alias("samples"))
    return days.join(pairs, USER, "left")


def _delivered(spark: SparkSession, folder: str) -> IncrementalTables:
    """The log in two deliveries with a refresh after each: later months go on, and heart rate variability comes late for earlier ones."""
    store, events = EventStore(spark, scratch(spark, "deliveries")), _events(spark, folder)
    tables = IncrementalTables(store, parts=8)
    first = (F.dayofyear("timestamp") <= 180) & (F.col("metric") != "hrv")
    for part in (events.where(first), events.where(~first)):
        store.append_events(part, "activity_log", 1)
        tables.refresh()
    return tables


def t2_incremental_overview(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_overview(_delivered(spark, folder).overview()).drop("updated_at")


def t2_incremental_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _delivered(spark, folder).pairs().withColumns(places("correlation"))


def t1_repeated_delivery(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the log, then all of it: events that are known already are left out."""
    store, events = EventStore(spark, scratch(spark, "repeated")), _events(spark, folder).distinct()
    for part in (events.where(F.hour("timestamp") < 12), events, events):
        store.append_events(part, "activity_log", 1, skip_known=True)
    return store.import_runs().select("source", "record_count", "user_count")


def all_queries() -> dict[str, Query]:
    """Every function above whose name starts with an operator id."""
    groups = "skfawoucrt"
    return {name: item for name, item in globals().items() if callable(item) and name[0] in groups and name[1:2].isdigit() and "_" in name}
