"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

from itertools import combinations

METRICS = ("steps", "sleep_minutes", "calories", "active_minutes", "resting_hr", "hrv")
SEVEN = METRICS + ("health_score",)
FLAGS = ("anomaly_low_sleep", "anomaly_low_activity", "anomaly_high_resting_hr")
SHORT_FLAGS = ("low_sleep", "low_activity", "high_resting_hr")
ZSCORES = ("steps_zscore", "sleep_zscore", "resting_hr_zscore", "hrv_zscore")
TREND = ("steps", "sleep_minutes", "resting_hr", "hrv", "health_score")
SUMMED = ("steps", "sleep_minutes", "calories", "active_minutes")


def r(name: str, alias: str | None = None, digits: int = 6) -> str:
    return f"round({name}, {digits}) + 0.0 AS {alias or name.split('.')[-1]}"


def rs(*names: str) -> str:
    return ", ".join(r(name) for name in names)


def exact(name: str, digits: int) -> str:
    """Correctly rounded from the exact binary value, ties to even."""
    return f"CAST(format('{{:.{digits}f}}', {name}) AS DOUBLE)"


def _wide_columns() -> str:
    return ",\n".join(f"{'sum' if m in SUMMED else 'avg'}(value) FILTER (WHERE metric = '{m}') AS {m}" for m in METRICS)


def _z(metric: str) -> str:
    return (
        f"coalesce(CASE WHEN count({metric}) OVER w >= 3 AND stddev_samp({metric}) OVER w > 0 "
        f"THEN ({metric} - avg({metric}) OVER w) / stddev_samp({metric}) OVER w END, 0.0)"
    )


def _samples() -> str:
    parts = []
    for a, b in combinations(SEVEN, 2):
        for lag in (0, 1):
            y = f"next_{b}" if lag else b
            parts.append(
                f"SELECT source_user_id, '{a}' AS metric_a, '{b}' AS metric_b, {lag} AS lag_days, {a} AS x, {y} AS y "
                f"FROM ahead WHERE {a} IS NOT NULL AND {y} IS NOT NULL"
            )
    return "\nUNION ALL ".join(parts)


FRAME = "WINDOW w AS (PARTITION BY source_user_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"

CANON = """canon AS (
SELECT ts AS "timestamp",
  CASE event_type WHEN 'view' THEN 'steps' WHEN 'signup' THEN 'sleep_minutes' WHEN 'click' THEN 'active_minutes'
    WHEN 'purchase' THEN 'calories' ELSE CASE WHEN event_id % 2 = 1 THEN 'resting_hr' ELSE 'hrv' END END AS metric,
  CASE event_type WHEN 'view' THEN value * 100::DOUBLE WHEN 'signup' THEN value * 6::DOUBLE WHEN 'click' THEN value
    WHEN 'purchase' THEN value * 20::DOUBLE ELSE 50::DOUBLE + value * 0.2::DOUBLE END AS value,
  CASE event_type WHEN 'view' THEN 'count' WHEN 'signup' THEN 'min' WHEN 'click' THEN 'min'
    WHEN 'purchase' THEN 'kcal' ELSE CASE WHEN event_id % 2 = 1 THEN 'bpm' ELSE 'ms' END END AS unit,
  'activity_log' AS source, CAST(user_id AS VARCHAR) AS source_user_id, props AS metadata_json
FROM events)"""

WIDE = f"wide AS (SELECT source_user_id, CAST(\"timestamp\" AS DATE) AS day, {_wide_columns()} FROM canon GROUP BY 1, 2)"


def overview_ctes(wide: str = "wide") -> str:
    return f"""scored AS (
SELECT *, least(coalesce(steps, 0) / 10000::DOUBLE, 1::DOUBLE) * 45
  + greatest(0::DOUBLE, 1 - abs(coalesce(sleep_minutes, 0) - 480) / 240::DOUBLE) * 35
  + least(coalesce(active_minutes, 0) / 60::DOUBLE, 1::DOUBLE) * 20 AS health_score
FROM {wide}),
zscored AS (
SELECT *, {_z('steps')} AS steps_zscore, {_z('sleep_minutes')} AS sleep_zscore, {_z('resting_hr')} AS resting_hr_zscore,
  {_z('hrv')} AS hrv_zscore FROM scored {FRAME}),
overview AS (
SELECT *, sleep_zscore <= -1.5 AS anomaly_low_sleep, steps_zscore <= -1.5 AS anomaly_low_activity,
  resting_hr_zscore >= 1.5 AS anomaly_high_resting_hr,
  row_number() OVER (PARTITION BY source_user_id ORDER BY day DESC) AS recency FROM zscored)"""


PAIRS = f"""ahead AS (
SELECT source_user_id, day, {', '.join(SEVEN)}, {', '.join(f'lead({m}) OVER n AS next_{m}' for m in SEVEN)}
FROM overview WINDOW n AS (PARTITION BY source_user_id ORDER BY day)),
samples AS ({_samples()}),
pairs AS (
SELECT source_user_id, metric_a, metric_b, CAST(lag_days AS INTEGER) AS lag_days, corr(x, y) AS correlation,
  CAST(count(*) AS INTEGER) AS sample_size
FROM samples GROUP BY ALL HAVING count(*) >= 3 AND corr(x, y) IS NOT NULL AND NOT isnan(corr(x, y))),
ranked AS (
SELECT *, CAST(row_number() OVER (PARTITION BY source_user_id
  ORDER BY round(abs(correlation), 9) DESC, metric_a, metric_b, lag_days) AS INTEGER) AS position FROM pairs)"""

LATEST = """newest AS (SELECT source_user_id FROM canon ORDER BY "timestamp" DESC, source_user_id DESC LIMIT 1)"""

STATS = f"""averages AS (
SELECT source_user_id, avg(steps) AS mean_steps, avg(sleep_minutes) AS mean_sleep FROM overview WHERE recency <= 7 GROUP BY 1),
stats AS (
SELECT source_user_id, day AS date, coalesce(CAST(trunc(steps) AS BIGINT), 0) AS steps,
  coalesce(CAST(trunc(mean_steps) AS BIGINT), 0) AS steps_7d_avg,
  CASE WHEN coalesce(steps, 0) > mean_steps * 1.1::DOUBLE THEN 'increasing'
    WHEN coalesce(steps, 0) < mean_steps * 0.9::DOUBLE THEN 'decreasing' ELSE 'stable' END AS steps_trend,
  coalesce(CAST(trunc(sleep_minutes) AS BIGINT), 0) AS sleep_minutes,
  coalesce(CAST(trunc(mean_sleep) AS BIGINT), 0) AS sleep_7d_avg,
  {exact('health_score', 1)} AS health_score, {r('resting_hr')}, {r('hrv')},
  anomaly_low_sleep AS low_sleep, anomaly_low_activity AS low_activity, anomaly_high_resting_hr AS high_resting_hr
FROM overview JOIN averages USING (source_user_id) WHERE recency = 1)"""

FLAGGED = f"""flagged AS (
SELECT source_user_id, day, {', '.join(f'{f} AS {f[8:]}' for f in FLAGS)},
  CAST(row_number() OVER (PARTITION BY source_user_id ORDER BY day DESC) AS INTEGER) AS place
FROM overview WHERE recency <= 14 AND ({' OR '.join(FLAGS)}))"""

FULL = "WITH " + ",\n".join([CANON, WIDE, overview_ctes(), PAIRS, LATEST, STATS, FLAGGED]) + "\n"
OVERVIEW_OUT = f"source_user_id, day, {rs(*SEVEN, *ZSCORES)}, {', '.join(FLAGS)}"
PAIR_OUT = f"source_user_id, metric_a, metric_b, lag_days, {r('correlation')}, sample_size"
LABELS = (
    "concat_ws(', ', CASE WHEN {0} THEN 'low sleep' END, CASE WHEN {1} THEN 'low activity' END, "
    "CASE WHEN {2} THEN 'high resting HR' END)"
)

# ---- vendor rows ---------------------------------------------------------------------------

LOG = "log AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k, CAST(user_id AS VARCHAR) AS u FROM events)"
SECOND = "date_trunc('second', ts)"

APPLE_CTE = f"""apple AS (
SELECT CASE WHEN k >= 50 THEN 'watch-' || u WHEN k >= 5 THEN 'phone-' || u ELSE 'apple_health' END AS source_user_id,
  {SECOND} AS "timestamp",
  CASE event_type WHEN 'view' THEN 'steps' WHEN 'signup' THEN 'sleep_minutes' WHEN 'purchase' THEN 'calories'
    WHEN 'error' THEN CASE WHEN event_id % 2 = 1 THEN 'resting_hr' ELSE 'hrv' END ELSE 'heart_rate' END AS metric,
  CASE WHEN event_type = 'signup' THEN CASE WHEN k < 10 OR k >= 95 THEN 0::DOUBLE ELSE k::DOUBLE END
    WHEN k >= 95 THEN 0::DOUBLE WHEN k < 90 THEN value END AS value,
  CASE WHEN k >= 30 THEN 'given' ELSE CASE event_type WHEN 'view' THEN 'count' WHEN 'signup' THEN 'min' WHEN 'purchase' THEN 'kcal'
    WHEN 'error' THEN CASE WHEN event_id % 2 = 1 THEN 'count/min' ELSE 'ms' END ELSE 'count/min' END END AS unit,
  'apple_health' AS source,
  CASE event_type WHEN 'view' THEN 'HKQuantityTypeIdentifierStepCount' WHEN 'signup' THEN 'HKCategoryTypeIdentifierSleepAnalysis'
    WHEN 'purchase' THEN 'HKQuantityTypeIdentifierActiveEnergyBurned'
    WHEN 'error' THEN CASE WHEN event_id % 2 = 1 THEN 'HKQuantityTypeIdentifierRestingHeartRate'
      ELSE 'HKQuantityTypeIdentifierHeartRateVariabilitySDNN' END
    ELSE 'HKQuantityTypeIdentifierHeartRate' END AS record_type,
  CASE WHEN k >= 5 THEN 'phone-' || u ELSE 'apple_health' END AS source_name
FROM log WHERE NOT (event_type = 'click' AND k >= 50))"""

ACTIVITY_CTE = "activity AS (" + "\nUNION ALL ".join(
    f"SELECT u AS source_user_id, date_trunc('day', ts) AS \"timestamp\", '{metric}' AS metric, "
    f"{f'CASE WHEN event_type = {kind!r} THEN value ELSE 0 END' if kind else '0::DOUBLE'} AS value, '{unit}' AS unit, "
    f"'fitbit' AS source, '{column}' AS \"column\" FROM log"
    for kind, metric, unit, column in (
        ("view", "steps", "count", "TotalSteps"),
        ("purchase", "calories", "kcal", "Calories"),
        ("click", "very_active_minutes", "min", "VeryActiveMinutes"),
        ("error", "fairly_active_minutes", "min", "FairlyActiveMinutes"),
        (None, "lightly_active_minutes", "min", "LightlyActiveMinutes"),
        ("signup", "sedentary_minutes", "min", "SedentaryMinutes"),
    )
) + ")"

SLEEP_CTE = f"""sleep AS (
SELECT u AS source_user_id, {SECOND} AS "timestamp", 'sleep_minutes' AS metric,
  CASE WHEN event_type = 'signup' THEN value ELSE 0 END AS value, 'min' AS unit, 'fitbit' AS source, 'TotalMinutesAsleep' AS "column" FROM log
UNION ALL
SELECT u, {SECOND}, 'time_in_bed_minutes', value, 'min', 'fitbit', 'TotalTimeInBed' FROM log)"""

GOOGLE_CTE = """google AS (
SELECT CASE WHEN k >= 5 THEN 'g-' || u ELSE 'google-user' END AS source_user_id, ts AS "timestamp",
  CASE event_type WHEN 'view' THEN 'steps' WHEN 'signup' THEN 'active_minutes' WHEN 'purchase' THEN 'calories'
    WHEN 'error' THEN CASE WHEN event_id % 2 = 1 THEN 'resting_hr' ELSE 'hrv' END ELSE 'heart_rate' END AS metric,
  CASE WHEN k < 25 THEN CASE WHEN value <> 0 THEN value ELSE floor(value) END WHEN k < 50 THEN floor(value)
    WHEN k < 95 THEN value ELSE 0 END AS value,
  CASE WHEN k >= 30 THEN 'given' ELSE CASE event_type WHEN 'view' THEN 'count' WHEN 'signup' THEN 'min' WHEN 'purchase' THEN 'kcal'
    WHEN 'error' THEN CASE WHEN event_id % 2 = 1 THEN 'bpm' ELSE 'ms' END ELSE 'bpm' END END AS unit,
  'google_health' AS source,
  CASE event_type WHEN 'view' THEN 'com.google.step_count.delta' WHEN 'signup' THEN 'com.google.heart_minutes'
    WHEN 'purchase' THEN 'com.google.calories.expended'
    WHEN 'error' THEN CASE WHEN event_id % 2 = 1 THEN 'com.google.resting_heart_rate.bpm' ELSE 'com.google.hrv' END
    ELSE 'com.google.heart_rate.bpm' END AS data_type_name
FROM log WHERE NOT (event_type = 'click' AND k >= 50))"""

OURA_CTE = """oura AS (
SELECT CASE WHEN k >= 5 THEN 'o-' || u ELSE 'oura-user' END AS source_user_id, date_trunc('day', ts) AS "timestamp",
  CASE event_type WHEN 'view' THEN 'steps' WHEN 'signup' THEN 'sleep_minutes' WHEN 'purchase' THEN 'calories'
    WHEN 'click' THEN 'active_minutes' ELSE CASE WHEN event_id % 2 = 1 THEN 'resting_hr' ELSE 'hrv' END END AS metric,
  value,
  CASE event_type WHEN 'view' THEN 'count' WHEN 'signup' THEN 'min' WHEN 'purchase' THEN 'kcal' WHEN 'click' THEN 'min'
    ELSE CASE WHEN event_id % 2 = 1 THEN 'bpm' ELSE 'ms' END END AS unit,
  'oura' AS source,
  CASE WHEN event_type IN ('signup', 'error') THEN 'sleep' ELSE 'activity' END AS section,
  CASE event_type WHEN 'view' THEN 'steps' WHEN 'signup' THEN 'total_sleep_duration' WHEN 'purchase' THEN 'active_calories'
    WHEN 'click' THEN 'active_duration' ELSE CASE WHEN event_id % 2 = 1 THEN 'hr_average' ELSE 'hrv_average' END END AS field
FROM log)"""

GARMIN_CTE = "garmin AS (" + "\nUNION ALL ".join(
    f"SELECT CASE WHEN k >= 50 THEN 'm-' || u ELSE 'garmin-user' END AS source_user_id, ts AS \"timestamp\", '{metric}' AS metric, "
    f"value, '{unit}' AS unit, 'garmin' AS source, 'record' AS message_name, '{field}' AS field FROM log WHERE k >= 5 AND event_type IN ({kinds})"
    for field, metric, unit, kinds in (
        ("steps", "steps", "count", "'view'"),
        ("calories", "calories", "kcal", "'purchase'"),
        ("heart_rate", "heart_rate", "bpm", "'click', 'signup'"),
        ("resting_heart_rate", "resting_hr", "bpm", "'error', 'signup'"),
    )
) + ")"

MANUAL_CTE = f"""manual AS (
SELECT CASE WHEN k >= 50 THEN 'u-' || u ELSE 'manual-user' END AS source_user_id,
  CASE WHEN k < 20 THEN date_trunc('day', ts) ELSE {SECOND} END AS "timestamp", event_type AS metric,
  CASE WHEN k < 90 THEN value ELSE 100 END AS value, CASE WHEN k >= 30 THEN 'given' ELSE 'unit' END AS unit, 'manual' AS source,
  'manual_csv' AS input FROM log WHERE k < 95)"""

VENDOR = "WITH " + ",\n".join([LOG, APPLE_CTE, ACTIVITY_CTE, SLEEP_CTE, GOOGLE_CTE, OURA_CTE, GARMIN_CTE, MANUAL_CTE]) + "\n"


def _vendor_rows(table: str, *keys: str) -> str:
    extra = "".join(f', "{key}"' for key in keys)
    return f'{VENDOR}SELECT source_user_id, "timestamp", metric, {r("value")}, unit, source{extra} FROM {table} WHERE value IS NOT NULL'


def _all_vendors() -> str:
    tables = ("apple", "activity", "sleep", "google", "oura", "garmin", "manual")
    return " UNION ALL ".join(f"SELECT source, metric, unit, source_user_id, value FROM {t} WHERE value IS NOT NULL" for t in tables)


def _sources() -> dict[str, str]:
    name = """CASE event_type WHEN 'view' THEN CASE WHEN k < 20 THEN 'dailyactivity_merged.csv' ELSE 'notes.csv' END
      WHEN 'signup' THEN CASE WHEN k < 50 THEN 'my_oura_data.json' ELSE 'takeout.json' END
      WHEN 'purchase' THEN CASE WHEN k < 10 THEN 'sleepday_merged.csv' ELSE 'ride.fit' END
      WHEN 'click' THEN CASE WHEN k < 10 THEN 'export.xml' ELSE 'zebra.txt' END ELSE 'metrics.csv' END"""
    tracker_wide = """tracker AS (
      SELECT source_user_id, CAST("timestamp" AS DATE) AS day, sum(value) FILTER (WHERE metric = 'steps') AS steps,
        sum(value) FILTER (WHERE metric = 'sleep_minutes') AS sleep_minutes, sum(value) FILTER (WHERE metric = 'calories') AS calories,
        NULL::DOUBLE AS active_minutes, NULL::DOUBLE AS resting_hr, NULL::DOUBLE AS hrv
      FROM (SELECT source_user_id, "timestamp", metric, value FROM activity UNION ALL SELECT source_user_id, "timestamp", metric, value FROM sleep)
      GROUP BY 1, 2)"""
    return {
        "s1_apple": _vendor_rows("apple", "record_type", "source_name"),
        "s1_apple_files": _vendor_rows("apple", "record_type", "source_name"),
        "s1_apple_asleep": _vendor_rows("apple", "record_type", "source_name") + " AND (metric <> 'sleep_minutes' OR source_user_id LIKE 'watch-%')",
        "s2_fitbit_activity": _vendor_rows("activity", "column"),
        "s3_fitbit_sleep": _vendor_rows("sleep", "column"),
        "s4_google": _vendor_rows("google", "data_type_name"),
        "s5_oura": _vendor_rows("oura", "section", "field"),
        "s6_garmin": _vendor_rows("garmin", "message_name", "field"),
        "s7_manual": _vendor_rows("manual", "input"),
        "s7_manual_rejected": f"""WITH {LOG} SELECT event_type AS metric,
            CASE WHEN k >= 98 THEN 'timestamp' ELSE 'value' END AS reject_reason, count(*) AS n FROM log WHERE k >= 95 GROUP BY 1, 2""",
        "s8_infer_source": f"""WITH {LOG}, named AS (
            SELECT 'uploads/' || u || '/' || strftime(ts, '%Y-%m-%d') AS folder, {name} AS name FROM log)
            SELECT folder, count(*) AS file_count,
              CASE WHEN bool_or(name = 'export.xml') THEN 'apple_health'
                WHEN bool_or(name IN ('dailyactivity_merged.csv', 'sleepday_merged.csv')) THEN 'fitbit'
                WHEN min(name) LIKE '%oura%.json' THEN 'oura' WHEN min(name) LIKE '%.json' THEN 'google_health'
                WHEN min(name) LIKE '%.fit' THEN 'garmin' WHEN min(name) LIKE '%.csv' THEN 'manual' END AS source
            FROM named GROUP BY folder""",
        "s9_load_files": f"""{VENDOR}SELECT source, metric, unit, count(*) AS n, count(DISTINCT source_user_id) AS users,
            {r('sum(value)', 'total', 4)} FROM ({_all_vendors()}) WHERE source IN ('fitbit', 'manual', 'apple_health') GROUP BY 1, 2, 3""",
        "s9_load_documents": f"""{VENDOR}SELECT source, metric, unit, count(*) AS n, count(DISTINCT source_user_id) AS users,
            {r('sum(value)', 'total', 4)} FROM ({_all_vendors()}) WHERE source IN ('google_health', 'oura', 'garmin') GROUP BY 1, 2, 3""",
        "s10_bootstrap": f"""{VENDOR}SELECT 'fitbit' AS source, count(*) AS record_count, count(DISTINCT source_user_id) AS user_count FROM sleep""",
        "s11_load_data": f"""{VENDOR}, {tracker_wide}, {overview_ctes('tracker')},
            newest AS (SELECT source_user_id FROM sleep ORDER BY "timestamp" DESC, source_user_id DESC LIMIT 1)
            SELECT source_user_id, day, {rs('steps', 'sleep_minutes', 'calories', 'health_score', 'steps_zscore')}
            FROM overview JOIN newest USING (source_user_id)""",
        "u1_union_sources": f"""{VENDOR}SELECT source, metric, count(*) AS n, {r('sum(value)', 'total', 4)}
            FROM ({_all_vendors()}) GROUP BY 1, 2""",
        "f1_metric_map": f"""{VENDOR}SELECT record_type, metric, count(*) AS n FROM apple GROUP BY 1, 2""",
        "c11_metadata_json": f"""{VENDOR}SELECT '{{"field":"' || field || '","section":"' || section || '"}}' AS metadata_json, count(*) AS n
            FROM oura GROUP BY 1""",
        "c12_headers": f"""WITH {LOG} SELECT event_type AS metric, count(*) AS timestamps, count(*) AS "values",
            count(*) FILTER (WHERE k >= 10) AS units, count(*) FILTER (WHERE k >= 50) AS users FROM log GROUP BY 1""",
    }


def _store() -> dict[str, str]:
    event = f"\"timestamp\", metric, {r('value')}, unit, source, source_user_id, metadata_json"
    return {
        "k1_append_events": f"{FULL}SELECT {event} FROM canon",
        "k2_import_audit": f"""{FULL}SELECT 'activity_log' AS source, 1::INTEGER AS file_count, count(*) AS record_count,
            count(DISTINCT source_user_id) AS user_count FROM canon
            UNION ALL SELECT 'second_log', 2, count(*), count(DISTINCT source_user_id) FROM canon WHERE metric = 'hrv'""",
        "k1_compacted_events": f"{FULL}SELECT {event} FROM canon",
        "k2_compacted_audit": f"""{FULL}SELECT 'log_' || CAST(extract(hour FROM "timestamp") % 6 AS VARCHAR) AS source, 1::INTEGER AS file_count,
            count(*) AS record_count, count(DISTINCT source_user_id) AS user_count FROM canon GROUP BY 1""",
        "k3_replace_overview": f"{FULL}SELECT {OVERVIEW_OUT} FROM overview",
        "k4_replace_pairs": f"{FULL}SELECT {PAIR_OUT} FROM pairs",
        "k5_scan_events": f"{FULL}SELECT {event} FROM canon WHERE source_user_id = '7'",
        "k6_scan_overview": f"{FULL}SELECT {OVERVIEW_OUT} FROM overview WHERE source_user_id = '7'",
        "k7_scan_pairs": f"{FULL}SELECT {PAIR_OUT} FROM pairs WHERE source_user_id = '7' AND lag_days = 1",
        "a7_import_users": f"""{FULL}SELECT DISTINCT 'activity_log' AS source, source_user_id FROM canon
            UNION ALL SELECT DISTINCT 'second_log', source_user_id FROM canon WHERE metric = 'hrv'""",
        "t1_incremental_import": f"{FULL}SELECT {OVERVIEW_OUT} FROM overview",
        "t2_incremental_overview": f"{FULL}SELECT {OVERVIEW_OUT} FROM overview",
        "t2_incremental_pairs": f"{FULL}SELECT {PAIR_OUT} FROM pairs",
        "t1_repeated_delivery": f"""{FULL}, once AS (SELECT DISTINCT * FROM canon), parts AS (SELECT extract(hour FROM "timestamp") < 12 AS early, * FROM once)
            SELECT 'activity_log' AS source, count(*) AS record_count, count(DISTINCT source_user_id) AS user_count FROM parts GROUP BY early""",
        "t2_refresh": f"""{FULL}, days AS (SELECT source_user_id, count(*) AS days, {r('sum(health_score)', 'score')},
            count(*) FILTER (WHERE {' OR '.join(FLAGS)}) AS anomalies FROM overview GROUP BY 1),
            found AS (SELECT source_user_id, count(*) AS pairs, CAST(sum(sample_size) AS BIGINT) AS samples FROM pairs GROUP BY 1)
            SELECT * FROM days LEFT JOIN found USING (source_user_id)""",
    }


def _filters() -> dict[str, str]:
    only = ", ".join(r(m) if m in ("steps", "hrv") else f"NULL::DOUBLE AS {m}" for m in METRICS)
    return {
        "f2_event_day": f"{FULL}SELECT CAST(\"timestamp\" AS DATE) AS day, count(*) AS n FROM canon GROUP BY 1",
        "f3_absent_columns": f"{FULL}SELECT source_user_id, day, {only} FROM wide WHERE steps IS NOT NULL OR hrv IS NOT NULL",
        "f4_select_user": f"{FULL}SELECT {OVERVIEW_OUT} FROM overview JOIN newest USING (source_user_id)",
        "f5_overview": f"{FULL}SELECT {OVERVIEW_OUT} FROM overview",
        "f6_any_anomaly": f"{FULL}SELECT source_user_id, day, {', '.join(FLAGS)} FROM overview WHERE {' OR '.join(FLAGS)}",
        "f7_lag_filter": f"{FULL}SELECT {PAIR_OUT} FROM pairs WHERE lag_days = 1",
        "f8_sample_rule": f"""{FULL}SELECT metric_a, metric_b, lag_days, count(*) AS users, count(*) FILTER (WHERE n >= 3) AS kept,
            CAST(sum(n) AS BIGINT) AS samples FROM (SELECT source_user_id, metric_a, metric_b, lag_days, count(*) AS n FROM samples GROUP BY ALL)
            GROUP BY 1, 2, 3""",
        "f9_pair_search": f"{FULL}SELECT {PAIR_OUT} FROM pairs WHERE contains(metric_a || ' ' || metric_b, 'steps h')",
    }


def _aggregates() -> dict[str, str]:
    both = """both_ways AS (SELECT source_user_id, metric_a AS metric, metric_b AS other, correlation FROM pairs WHERE lag_days = 0
        UNION ALL SELECT source_user_id, metric_b, metric_a, correlation FROM pairs WHERE lag_days = 0)"""
    cells = ", ".join(f"max({exact('correlation', 3)}) FILTER (WHERE other = '{m}') AS {m}" for m in SEVEN)
    summed = ", ".join(f"'{m}'" for m in SUMMED)
    return {
        "a1_daily_reduce": f"""{FULL}SELECT source_user_id, CAST("timestamp" AS DATE) AS day, metric,
            round(CASE WHEN metric IN ({summed}) THEN sum(value) ELSE avg(value) END, 6) + 0.0 AS value FROM canon GROUP BY 1, 2, 3""",
        "a2_daily_pivot": f"{FULL}SELECT source_user_id, day, {rs(*METRICS)} FROM wide",
        "a2_pivot_reduced": f"{FULL}SELECT source_user_id, day, {rs(*METRICS)} FROM wide",
        "a3_correlation_pairs": f"{FULL}SELECT {PAIR_OUT} FROM pairs",
        "a4_sample_size": f"""{FULL}SELECT metric_a, metric_b, lag_days, count(*) AS users, CAST(sum(sample_size) AS BIGINT) AS samples,
            max(sample_size) AS largest FROM pairs GROUP BY 1, 2, 3""",
        "a5_event_count": f"{FULL}SELECT count(*) AS n, count(*) > 0 AS has_events FROM canon",
        "a6_users": f"{FULL}SELECT DISTINCT source_user_id FROM canon",
        "a8_recent_means": f"{FULL}SELECT source_user_id, steps_7d_avg, sleep_7d_avg FROM stats",
        "a9_correlation_matrix": f"{FULL}, {both} SELECT source_user_id, metric, other, {exact('correlation', 3)} AS correlation FROM both_ways",
        "a9_matrix_wide": f"{FULL}, {both} SELECT source_user_id, metric, {cells} FROM both_ways GROUP BY 1, 2",
        "a10_heatmap": f"""{FULL}, {both}, places AS (
            SELECT source_user_id, metric_a, metric_b, row_number() OVER (PARTITION BY source_user_id
              ORDER BY round(abs(correlation), 9) DESC, metric_a, metric_b) AS place FROM pairs WHERE lag_days = 0),
            seen AS (SELECT source_user_id, metric_a AS label, place * 2 AS place FROM places
              UNION ALL SELECT source_user_id, metric_b, place * 2 + 1 FROM places),
            labels AS (SELECT source_user_id, label,
              CAST(row_number() OVER (PARTITION BY source_user_id ORDER BY min(place)) - 1 AS INTEGER) AS position FROM seen GROUP BY 1, 2)
            SELECT a.source_user_id, a.position AS row_position, a.label AS row_label, b.position AS column_position, b.label AS column_label,
              coalesce({exact('c.correlation', 3)}, CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS correlation
            FROM labels a JOIN labels b ON a.source_user_id = b.source_user_id
            LEFT JOIN both_ways c ON c.source_user_id = a.source_user_id AND c.metric = a.label AND c.other = b.label""",
        "a11_profile": f"""{FULL}SELECT count(DISTINCT day) AS days, {exact('count(DISTINCT day) / 7::DOUBLE', 1)} AS weeks,
            min(day) AS first_day, max(day) AS last_day, count(*) FILTER (WHERE anomaly_low_sleep) AS low_sleep,
            count(*) FILTER (WHERE anomaly_low_activity) AS low_activity, count(*) FILTER (WHERE anomaly_high_resting_hr) AS high_resting_hr,
            count(*) FILTER (WHERE anomaly_low_sleep) + count(*) FILTER (WHERE anomaly_low_activity)
              + count(*) FILTER (WHERE anomaly_high_resting_hr) AS anomalies FROM overview""",
    }


def _windows() -> dict[str, str]:
    rolling = ("steps", "sleep_minutes", "resting_hr", "hrv")
    means = ", ".join(f"round(CASE WHEN count({m}) OVER w >= 3 THEN avg({m}) OVER w END, 6) + 0.0 AS {m}_mean" for m in rolling)
    stds = ", ".join(
        f"round(CASE WHEN count({m}) OVER w >= 3 AND stddev_samp({m}) OVER w > 0 THEN stddev_samp({m}) OVER w END, 6) + 0.0 AS {m}_std"
        for m in rolling
    )
    zs = ", ".join(f"round({_z(m)}, 6) + 0.0 AS {m}_zscore" for m in rolling)
    return {
        "w1_rolling_mean": f"{FULL}SELECT source_user_id, day, {means} FROM wide {FRAME}",
        "w2_rolling_std": f"{FULL}SELECT source_user_id, day, {stds} FROM wide {FRAME}",
        "w3_rolling_zscore": f"{FULL}SELECT source_user_id, day, {zs} FROM wide {FRAME}",
        "w4_next_row": f"{FULL}SELECT source_user_id, day, {rs(*[f'next_{m}' for m in SEVEN])} FROM ahead",
        "w5_trend_slice": f"{FULL}SELECT source_user_id, day, {rs(*TREND)} FROM overview WHERE recency <= 21",
        "w6_recent_anomalies": f"{FULL}SELECT source_user_id, day, {', '.join(SHORT_FLAGS)} FROM flagged",
        "w7_last_seven": f"""{FULL}SELECT source_user_id, day, CAST(recency AS INTEGER) AS recency, {rs('steps', 'sleep_minutes')}
            FROM overview WHERE recency <= 7""",
        "w8_latest_day": f"""{FULL}SELECT source_user_id, day, {rs('steps', 'sleep_minutes', 'resting_hr', 'hrv')},
            {exact('health_score', 1)} AS health_score FROM overview WHERE recency = 1""",
        "o1_latest_user": f"{FULL}SELECT source_user_id FROM newest",
        "o2_user_day_order": f"""{FULL}SELECT source_user_id, day,
            CAST(row_number() OVER (PARTITION BY source_user_id ORDER BY day) AS INTEGER) AS place FROM overview""",
        "o3_pair_order": f"{FULL}SELECT {PAIR_OUT}, position FROM ranked",
        "o4_top_pairs": f"{FULL}SELECT {PAIR_OUT}, position FROM ranked WHERE position <= 5",
        "o5_last_anomalies": f"""{FULL}SELECT source_user_id, day, place, {LABELS.format(*SHORT_FLAGS)} AS labels
            FROM flagged WHERE place <= 5""",
    }


def _scalars() -> dict[str, str]:
    later = "(ts + to_minutes(CAST(floor(value) AS INTEGER)))"
    gap = f"date_diff('second', {SECOND}, date_trunc('second', {later})) / 60::DOUBLE"
    text = ", ".join(
        f"coalesce(CAST(round({m}, 3) AS VARCHAR), 'n/a') AS {m}" for m in ("steps", "sleep_minutes", "resting_hr", "hrv")
    )
    insight = "source_user_id, CAST(date AS VARCHAR) AS date, steps, sleep_minutes, health_score, resting_hr, hrv, steps_trend, sleep_7d_avg AS avg_sleep_7d"
    return {
        "c1_health_score": f"{FULL}SELECT source_user_id, day, {r('health_score')} FROM scored",
        "c2_anomaly_flags": f"{FULL}SELECT source_user_id, day, {', '.join(FLAGS)} FROM overview",
        "c3_steps_trend": f"{FULL}SELECT source_user_id, steps, steps_trend FROM stats",
        "c4_user_stats": f"{FULL}SELECT * FROM stats",
        "c5_insight_json": f"{FULL}SELECT {insight}, {', '.join(SHORT_FLAGS)} FROM stats",
        "c6_report_labels": f"{FULL}SELECT source_user_id, {text}, {LABELS.format(*FLAGS)} AS labels FROM overview WHERE recency = 1",
        "c6_pair_labels": f"""{FULL}SELECT metric_a || ' vs ' || metric_b || ' (lag ' || lag_days || 'd)' AS label, count(*) AS n
            FROM pairs GROUP BY 1""",
        "c7_null_safe": f"""{FULL}SELECT {', '.join(f'count(*) - count({m}) AS {m}_missing' for m in METRICS)},
            {', '.join(r(f'coalesce(sum({m}), 0)', f'{m}_total', 3) for m in METRICS)} FROM wide""",
        "c8_rounding": f"SELECT event_id, {', '.join(f'{exact("value / 8::DOUBLE", d)} AS round_{d}' for d in (1, 2, 3))} FROM events",
        "c9_date_parsing": f"""SELECT event_id, {SECOND} AS with_offset, {SECOND} AS without_offset, {SECOND} AS us_time,
            date_trunc('day', ts) AS us_day, ts AS iso, ts + INTERVAL 1 MICROSECOND AS from_nanos, true AS bad_is_null FROM events""",
        "c10_durations": f"""SELECT event_id, {r(gap, 'same_zone')}, {r(f'({gap} + 60)', 'zone_change')},
            0.0::DOUBLE AS backwards, {r('value / 60::DOUBLE', 'from_seconds')} FROM events""",
        "c13_bands": f"""{FULL}SELECT source_user_id, CASE WHEN health_score > 80 THEN 'high' WHEN health_score > 50 THEN 'middle' ELSE 'low' END AS band,
            sleep_minutes // 60 AS sleep_hours, sleep_minutes % 60 AS sleep_rest,
            CASE steps_trend WHEN 'increasing' THEN '↑' WHEN 'decreasing' THEN '↓' ELSE '→' END AS arrow FROM stats""",
    }


def _read_models() -> dict[str, str]:
    latest = f"""latest AS (
        SELECT source_user_id, day AS latest_day, {exact('health_score', 1)} AS latest_score, {r('steps', 'latest_steps')},
          (SELECT count(*) FROM overview o WHERE o.source_user_id = l.source_user_id AND o.recency <= 21) AS trend_rows,
          (SELECT count(*) FROM flagged f WHERE f.source_user_id = l.source_user_id) AS anomaly_rows
        FROM overview l WHERE recency = 1)"""
    r3 = exact("correlation", 3)
    metric_text = "coalesce(CAST({} AS VARCHAR), 'n/a')"
    metric_rows = " UNION ALL ".join(
        f"SELECT source_user_id, 'Latest Metrics', {place}, '{label}', {metric_text.format(value)} FROM overview WHERE recency = 1"
        for place, (label, value) in enumerate(
            (
                ("Health score", exact("health_score", 1)),
                ("Steps", "steps"),
                ("Sleep minutes", "sleep_minutes"),
                ("Resting HR", "resting_hr"),
                ("HRV", "hrv"),
            ),
            start=1,
        )
    )
    return {
        "r1_overview": f"""{FULL}, {latest} SELECT source_user_id, latest_day, latest_score, CAST(trend_rows AS INTEGER) AS trend_days,
            CAST(anomaly_rows AS INTEGER) AS anomaly_days,
            CAST(row_number() OVER (PARTITION BY source_user_id ORDER BY day) - 1 AS INTEGER) AS position, day, {rs(*TREND)}
            FROM overview JOIN latest USING (source_user_id) WHERE recency <= 21""",
        "r2_correlations": f"""{FULL}SELECT a.source_user_id, a.position, a.metric_a, a.metric_b, a.lag_days,
            {exact('a.correlation', 3)} AS correlation, a.sample_size, {exact('b.correlation', 3)} AS cell, {exact('b.correlation', 3)} AS mirror
            FROM ranked a LEFT JOIN pairs b ON b.source_user_id = a.source_user_id AND b.metric_a = a.metric_a AND b.metric_b = a.metric_b
              AND b.lag_days = 0""",
        "r2_pair_list": f"""{FULL}SELECT source_user_id, metric_a, metric_b, lag_days, {r3} AS correlation, sample_size,
            CAST(row_number() OVER (PARTITION BY source_user_id ORDER BY position) AS INTEGER) AS position FROM ranked WHERE lag_days = 1""",
        "r3_narrative": f"""{FULL}SELECT s.source_user_id, CAST(date AS VARCHAR) AS date, steps, steps_trend, sleep_7d_avg AS avg_sleep_7d,
            position - 1 AS position, metric_a, metric_b, lag_days, {r3} AS correlation, sample_size
            FROM stats s LEFT JOIN (SELECT * FROM ranked WHERE position <= 3) p ON p.source_user_id = s.source_user_id""",
        "r3_chat_context": f"""{FULL}, {latest}, counted AS (
            SELECT source_user_id, count(*) AS pair_rows, max(metric_a) FILTER (WHERE position = 1) AS strongest_a,
              max({r3}) FILTER (WHERE position = 1) AS strongest FROM ranked WHERE position <= 5 GROUP BY 1)
            SELECT source_user_id, CAST(latest_day AS VARCHAR) AS latest_day, latest_steps, latest_score, CAST(trend_rows AS INTEGER) AS trend_days,
              CAST(anomaly_rows AS INTEGER) AS anomaly_days, CAST(coalesce(pair_rows, 0) AS INTEGER) AS pair_count, strongest_a, strongest
            FROM latest LEFT JOIN counted USING (source_user_id)""",
        "r4_report": f"""{FULL}, kept AS (
            SELECT *, row_number() OVER (PARTITION BY source_user_id ORDER BY day) AS line FROM flagged WHERE place <= 5),
            lines(source_user_id, section, position, label, text) AS (
            SELECT source_user_id, 'Latest Metrics', 0, 'Latest day', CAST(day AS VARCHAR) FROM overview WHERE recency = 1
            UNION ALL {metric_rows}
            UNION ALL SELECT source_user_id, 'Recent Anomalies', line, CAST(day AS VARCHAR), {LABELS.format(*SHORT_FLAGS)} FROM kept
            UNION ALL SELECT source_user_id, 'Recent Anomalies', 1, '', 'No recent anomaly flags.' FROM overview
              WHERE recency = 1 AND source_user_id NOT IN (SELECT source_user_id FROM flagged)
            UNION ALL SELECT source_user_id, 'Strongest Correlations', position, metric_a || ' vs ' || metric_b || ' (lag ' || lag_days || 'd)',
              'corr=' || {r3} || ' across ' || sample_size || ' samples' FROM ranked WHERE position <= 5
            UNION ALL SELECT source_user_id, 'Strongest Correlations', 1, '', 'Not enough data for correlation analysis yet.' FROM overview
              WHERE recency = 1 AND source_user_id NOT IN (SELECT source_user_id FROM pairs))
            SELECT source_user_id, section, CAST(position AS INTEGER) AS position, label, text FROM lines""",
    }


def all_oracles() -> dict[str, str]:
    return {**_sources(), **_store(), **_filters(), **_aggregates(), **_windows(), **_scalars(), **_read_models()}
