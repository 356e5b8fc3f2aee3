from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import correlation_pairs, daily_overview
from pulseframe.plans import user_stats
from pulseframe.schema import EVENT
from pulseframe.sources import accepted, classify_uploads, infer_source, load_events, parse_files, rejected
from pulseframe.sources.apple import apple_events, read_apple
from pulseframe.sources.garmin import garmin_events
from pulseframe.sources.manual import manual_events

ACTIVITY = """Id,ActivityDate,TotalSteps,Calories,VeryActiveMinutes,FairlyActiveMinutes,LightlyActiveMinutes,SedentaryMinutes
walker-7,1/9/2033,7800,1890,11,25,150,801
walker-7,1/10/2033,12400,2330,40,16,201,655
walker-7,1/11/2033,5150,1715,6,9,140,870
walker-7,1/12/2033,9900,2120,28,14,190,701
"""
SLEEP = """Id,SleepDay,TotalMinutesAsleep,TotalTimeInBed
walker-7,1/9/2033 12:00:00 AM,455,480
walker-7,1/10/2033 12:00:00 AM,372,401
walker-7,1/11/2033 12:00:00 AM,501,533
walker-7,1/12/2033 12:00:00 AM,418,447
"""


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def triples(events):
    return sorted((r.metric, r.value, r.source_user_id) for r in events.collect())


@pytest.fixture
def tracker(spark, tmp_path):
    paths = [write(tmp_path / "dailyActivity_merged.csv", ACTIVITY), write(tmp_path / "sleepDay_merged.csv", SLEEP)]
    return load_events(spark, paths)


def test_tracker_events(tracker):
    rows = tracker.collect()
    assert len(rows) == 32 and tracker.schema.simpleString() == EVENT.simpleString()
    first = next(r for r in rows if r.metric == "sleep_minutes" and r.value == 372.0)
    assert (first.timestamp, first.unit, first.source) == (dt.datetime(2033, 1, 10), "min", "fitbit")
    assert json.loads(first.metadata_json) == {"column": "TotalMinutesAsleep"}


def test_tracker_overview(tracker):
    days = daily_overview(tracker).orderBy("day").collect()
    assert [round(d.health_score, 6) for d in days] == [66.454167, 64.25, 55.1125, 70.508333]
    assert [d.active_minutes for d in days] == [None] * 4
    assert [round(d.steps_zscore, 6) for d in days] == [0.0, 0.0, -0.899563, 0.352882]
    assert [round(d.sleep_zscore, 6) for d in days] == [0.0, 0.0, 0.892242, -0.337668]
    assert not any(d.anomaly_low_sleep or d.anomaly_low_activity or d.anomaly_high_resting_hr for d in days)


def test_tracker_pairs_and_stats(tracker):
    overview = daily_overview(tracker)
    pairs = correlation_pairs(overview).collect()
    assert len(pairs) == 12 and {(p.lag_days, p.sample_size) for p in pairs} == {(0, 4), (1, 3)}
    assert next(round(p.correlation, 6) for p in pairs if (p.metric_a, p.metric_b, p.lag_days) == ("steps", "sleep_minutes", 0)) == -0.999898
    stats = user_stats(overview).first()
    assert (stats.steps, stats.steps_7d_avg, stats.steps_trend, stats.sleep_7d_avg) == (9900, 8812, "increasing", 436)


def test_tracker_files_with_other_columns_and_cells(spark, tmp_path):
    """Column order differs between files, one lacks columns, cells are blank, missing or broken."""
    one = write(tmp_path / "a" / "dailyActivity_merged.csv", ACTIVITY)
    text = "﻿Calories,ActivityDate,Id,TotalSteps,Other\r\n,4/1/2026,b,NA,x\r\n55,4/2/2026,b,7,\r\noops,4/3/2026,b,1,\r\n1,someday,b,1,\r\n"
    two = write(tmp_path / "b c" / "dailyActivity_merged.csv", text)
    parsed = parse_files(spark, [one, two], "fitbit")
    mine = accepted(parsed).where("source_user_id = 'b'")
    steps = [(r.timestamp.day, r.metric, r.value) for r in mine.where("metric in ('steps', 'calories')").orderBy("timestamp", "metric").collect()]
    assert steps == [(1, "calories", 0.0), (1, "steps", 0.0), (2, "calories", 55.0), (2, "steps", 7.0), (3, "steps", 1.0)]
    assert mine.where("metric = 'sedentary_minutes'").agg(F.sum("value")).first()[0] == 0.0
    assert sorted(r.reject_reason for r in rejected(parsed).collect()) == ["timestamp"] * 6 + ["value"]


def test_tracker_needs_its_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_events(spark, [write(tmp_path / "other.csv", "a,b\n1,2\n")], "fitbit")
    with pytest.raises(ValueError, match="ActivityDate"):
        load_events(spark, [write(tmp_path / "dailyActivity_merged.csv", "a,b\n1,2\n")])


def test_duplicate_rows_add_up(spark, tmp_path):
    text = "Id,SleepDay,TotalSleepRecords,TotalMinutesAsleep,TotalTimeInBed\n" + "9,6/7/2030 12:00:00 AM,1,389,412\n" * 2
    events = load_events(spark, [write(tmp_path / "sleepDay_merged.csv", text)])
    assert daily_overview(events).first().sleep_minutes == 778.0


XML = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE HealthData [ <!ELEMENT HealthData (Record*)> ]>
<HealthData locale="en">
  <ExportDate value="2033-01-11"/>
  <Record type="HKQuantityTypeIdentifierStepCount" sourceName="Handset" unit="count" value="6420" startDate="2033-01-09 07:15:00 +0000" endDate="2033-01-09 07:15:00 +0000" />
  <Record type="HKQuantityTypeIdentifierRestingHeartRate" sourceName="Band" value="52" startDate="2033-01-09 08:40:00 +0000">
    <MetadataEntry key="k" value="v"/>
  </Record>
  <Record type="HKQuantityTypeIdentifierHeartRateVariabilitySDNN" sourceName="Band" unit="ms" value="38.7" startDate="2033-01-09 08:45:00 +0000" endDate="2033-01-09 08:45:00 +0000" />
  <Record type="HKCategoryTypeIdentifierSleepAnalysis" sourceName="Band" value="HKCategoryValueSleepAnalysisAsleep" startDate="2033-01-08 22:40:00 +0000" endDate="2033-01-09 05:25:00 +0000" />
  <Record type="HKQuantityTypeIdentifierBodyMass" sourceName="Scale" unit="kg" value="81" startDate="2033-01-09 08:45:00 +0000" />
  <Record type="HKQuantityTypeIdentifierHeartRate" device="&lt;HKDevice: 1&gt;" value="sixty" startDate="2033-01-09 08:45:00 +0000" />
  <Record type="HKQuantityTypeIdentifierHeartRate" device="&lt;HKDevice: 1&gt;" startDate="2033-01-09 23:30:00 -0800" />
  <Record type="HKQuantityTypeIdentifierHeartRate" value="61" startDate="yesterday" />
  <Correlation type="c" startDate="2033-01-09 08:45:00 +0000">
    <Record type="HKQuantityTypeIdentifierStepCount" sourceName="Handset" unit="count" value="6420" startDate="2033-01-09 07:15:00 +0000" endDate="2033-01-09 07:15:00 +0000" />
    <Record type="HKQuantityTypeIdentifierStepCount" sourceName="Nested" value="1" startDate="2033-01-09 07:15:00 +0000" />
  </Correlation>
</HealthData>
"""


def test_phone_export_in_splits(spark, tmp_path):
    """One file cut anywhere gives the rows of the whole file: many groups, tags over several lines, quotes, entities, a > in a value."""
    kind = "HKQuantityTypeIdentifierHeartRate"
    lines, want = ["<?xml version='1.0'?>\n<HealthData>"], []
    for i in range(400):
        record = f"""<Record type='{kind}' sourceName="a &amp; b > {i}"
            unit = "count/min" value="{i}" startDate="2030-02-01 08:00:00 +0000"{'/' if i % 3 else ''}>"""
        record += "" if i % 3 else "<MetadataEntry key='x' value='y'/></Record>"
        if i % 7 == 2:
            lines.append(f"<Correlation type='p>q/'>\n{record}\n{record}</Correlation><Correlation a='>'/>")
        elif i % 7 == 5:
            lines.append(f"<Correlation>{record}" + "<MetadataEntry key='pad' value='z'/>" * 40 + f"{record}</Correlation>\n")
        else:
            lines.append(record)
            want.append((f"a & b > {i}", str(i)))
    path = write(tmp_path / "export.xml", "\n".join([*lines, "</HealthData>"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("100m", "20k", "1500"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10")
            rows = read_apple(spark, [path])
            assert sorted((r._sourceName, r._value) for r in rows.collect()) == sorted(want)
            assert all(r._unit == "count/min" and r._device is None for r in rows.collect())
            assert read_apple(spark, [path], nested_in=None).count() > len(want)
            tasks = spark.read.option("lineSep", "<").text(path).rdd.getNumPartitions()
        assert tasks > 40
        assert "XML" not in rows._jdf.queryExecution().executedPlan().toString().replace("export.xml", "")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_phone_export(spark, tmp_path):
    path = write(tmp_path / "export.xml", XML)
    parsed = parse_files(spark, [path])
    assert triples(accepted(parsed)) == [
        ("heart_rate", 0.0, "<HKDevice: 1>"),
        ("hrv", 38.7, "Band"),
        ("resting_hr", 52.0, "Band"),
        ("sleep_minutes", 405.0, "Band"),
        ("steps", 6420.0, "Handset"),
    ]
    assert sorted(r.reject_reason for r in rejected(parsed).collect()) == ["timestamp", "value"]
    by_metric = {r.metric: r for r in accepted(parsed).collect()}
    assert by_metric["sleep_minutes"].timestamp == dt.datetime(2033, 1, 8, 22, 40)
    assert by_metric["heart_rate"].timestamp == dt.datetime(2033, 1, 9, 23, 30)
    assert by_metric["resting_hr"].unit == "count/min"
    assert json.loads(by_metric["heart_rate"].metadata_json) == {
        "record_type": "HKQuantityTypeIdentifierHeartRate",
        "source_name": "apple_health",
    }
    assert apple_events(read_apple(spark, [path], nested_in=None)).where("metric = 'steps'").count() == 3


def test_phone_exports_with_and_without_groups(spark, tmp_path):
    """Records inside groups go in whichever file; equal records elsewhere stay."""
    head, tail = XML.split("  <Correlation")[0], "</HealthData>\n"
    pressure = '<Correlation><Record type="HKQuantityTypeIdentifierBloodPressureSystolic" value="120" startDate="2033-01-09 08:45:00 +0000"/></Correlation>'
    with_groups = write(tmp_path / "a b" / "export.xml", XML)
    without = write(tmp_path / "c" / "export.xml", head + tail)
    other_groups = write(tmp_path / "d" / "export.xml", head + pressure + tail)
    for paths, want in (([with_groups], 1), ([without], 1), ([other_groups], 1), ([with_groups, without, other_groups], 3)):
        assert load_events(spark, paths).where("metric = 'steps'").count() == want


def test_phone_overview(spark, tmp_path):
    overview = daily_overview(load_events(spark, [write(tmp_path / "export.xml", XML)]))
    handset = overview.where("source_user_id = 'Handset'").first()
    assert handset.health_score == pytest.approx(28.89)
    assert [r.day for r in overview.where("source_user_id = 'Band'").orderBy("day").collect()] == [dt.date(2033, 1, 8), dt.date(2033, 1, 9)]


def point(kind, **fields):
    return {"dataTypeName": kind, "startTimeNanos": "1989964800000000000", **fields}


STEP, RATE = "com.google.step_count.delta", "com.google.resting_heart_rate.bpm"


def test_takeout_object_and_list(spark, tmp_path):
    points = [point(STEP, originDataSourceId="cloud-3", fitValue=[{"intVal": 5310}]), point(RATE, fitValue=[{"fpVal": 58.5}])]
    one = write(tmp_path / "one.json", json.dumps({"points": points}, indent=2))
    two = write(tmp_path / "two.json", json.dumps(points, indent=2))
    for path in (one, two):
        events = load_events(spark, [path])
        assert triples(events) == [("resting_hr", 58.5, "google-user"), ("steps", 5310.0, "cloud-3")]
        assert {r.timestamp for r in events.collect()} == {dt.datetime(2033, 1, 22)}
    assert load_events(spark, [one, two]).count() == 4


def test_takeout_value_chain(spark, tmp_path):
    nested = [{"value": {"fpVal": 2.5}}]
    points = [
        point(STEP, fitValue=[{"fpVal": 0, "intVal": 5}]),
        point(STEP, fitValue=[{"intVal": 0, "mapVal": nested}], unit="u"),
        point(STEP, fitValue=[{"mapVal": []}]),
        point(STEP, fitValue=[], value=1.5),
        point(STEP, value="12.5"),
        point(STEP),
        {"metric": STEP, "startTimeNanos": 1989964800000000000, "value": 9},
        {"dataTypeName": STEP, "value": 3},
        point("com.google.weight", value=80),
        point(STEP, value="many"),
    ]
    parsed = parse_files(spark, [write(tmp_path / "takeout.json", json.dumps({"points": points}))])
    assert sorted(r.value for r in accepted(parsed).collect()) == [0.0, 0.0, 1.5, 2.5, 5.0, 9.0, 12.5]
    assert {r.unit for r in accepted(parsed).collect()} == {"count", "u"}
    assert sorted(r.reject_reason for r in rejected(parsed).collect()) == ["timestamp", "value"]


def test_takeout_without_points(spark, tmp_path):
    path = write(tmp_path / "empty.json", json.dumps({"points": []}))
    assert load_events(spark, [path]).count() == 0


def test_ring_export(spark, tmp_path):
    body = {
        "user_id": "ring-11",
        "sleep": [{"day": "2033-01-21", "total_sleep_duration": 27000, "hr_average": 54, "hrv_average": 51}],
        "activity": [{"day": "2033-01-21", "steps": 8150, "active_calories": 388, "active_duration": 2700}],
    }
    partial = {"sleep": [{"day": "2033-01-23", "hr_average": 50}, {"day": "x", "hr_average": 1}]}
    paths = [write(tmp_path / "oura_a.json", json.dumps(body, indent=1)), write(tmp_path / "oura_b.json", json.dumps(partial))]
    parsed = parse_files(spark, paths)
    overview = daily_overview(accepted(parsed)).orderBy("day").collect()
    full = overview[0]
    assert (full.sleep_minutes, full.resting_hr, full.hrv, full.steps, full.calories, full.active_minutes) == (450, 54, 51, 8150, 388, 45)
    assert full.health_score == pytest.approx(82.3, abs=1e-6)
    assert overview[1].resting_hr == 50.0 and len(overview) == 2
    assert [r.reject_reason for r in rejected(parsed).collect()] == ["timestamp"]
    numeric_id = write(tmp_path / "oura_c.json", json.dumps({"user_id": 12, "activity": [{"day": "2026-04-03", "steps": 5}]}))
    assert triples(load_events(spark, [numeric_id])) == [("steps", 5.0, "12")]


def test_watch_messages(spark, tmp_path):
    lines = [
        {"message_name": "record", "timestamp": "2033-01-25T06:10:00", "steps": 2088, "heart_rate": 71},
        {"message_name": "record", "steps": 1},
        {"message_name": "session", "timestamp": "2033-01-25T09:20:00", "resting_heart_rate": 50, "user_profile_index": 3},
    ]
    path = write(tmp_path / "ride.fit", "\n".join(json.dumps(line) for line in lines))
    events = load_events(spark, [path])
    assert triples(events) == [("heart_rate", 71.0, "garmin-user"), ("resting_hr", 50.0, "3"), ("steps", 2088.0, "garmin-user")]
    row = daily_overview(events).where("source_user_id = 'garmin-user'").first()
    assert row.steps == 2088.0 and row.resting_hr is None
    narrow = spark.createDataFrame([(dt.datetime(2026, 4, 4), 5)], "timestamp timestamp_ntz, steps int")
    assert triples(accepted(garmin_events(narrow))) == [("steps", 5.0, "garmin-user")]


MANUAL = """timestamp,metric,value,unit,source,source_user_id
2033-01-20T06:30:00,steps,7300,count,diary,ada
2033-01-20T06:30:00,sleep_minutes,405,min,diary,ada
2033-01-20T06:30:00,resting_hr,62,bpm,diary,ada
"""


def test_manual(spark, tmp_path):
    events = load_events(spark, [write(tmp_path / "m.csv", MANUAL)])
    assert events.count() == 3
    assert daily_overview(events).first().health_score == pytest.approx(56.9125, abs=1e-6)


def test_manual_defaults_and_aliases(spark, tmp_path):
    other = " Date , METRIC,Value,User_ID\n2026-04-05,mood,7,\n4/6/2026,mood,8,me\nsoon,mood,1,me\n2026-04-05,,1,me\n2026-04-05,mood,high,me\n"
    paths = [write(tmp_path / "a.csv", MANUAL), write(tmp_path / "b.csv", other)]
    parsed = parse_files(spark, paths)
    mood = accepted(parsed).where("metric = 'mood'").orderBy("timestamp").collect()
    assert [(m.timestamp, m.value, m.unit, m.source, m.source_user_id) for m in mood] == [
        (dt.datetime(2026, 4, 5), 7.0, "unit", "manual", "manual-user"),
        (dt.datetime(2026, 4, 6), 8.0, "unit", "manual", "me"),
    ]
    assert accepted(parsed).count() == 5
    assert sorted(r.reject_reason for r in rejected(parsed).collect()) == ["metric", "timestamp", "value"]


def test_manual_missing_columns(spark, tmp_path):
    path = write(tmp_path / "bad.csv", "date,unit,source\n2033-01-20T06:30:00,count,diary\n")
    with pytest.raises(ValueError, match="metric, value"):
        load_events(spark, [path])
    with pytest.raises(ValueError, match="timestamp, value"):
        manual_events(spark.createDataFrame([("a",)], "metric string"))


@pytest.mark.parametrize(
    "names, want",
    [
        (["x/Export.XML", "a.csv"], "apple_health"),
        (["a.json", "sleepDay_merged.csv"], "fitbit"),
        (["my_OURA.json"], "oura"),
        (["takeout.json", "oura.json"], "google_health"),
        (["ride.FIT"], "garmin"),
        (["notes.csv", "z.json"], "manual"),
        (["s/dailyActivity_merged.csv/part-0001-a.csv"], "fitbit"),
    ],
)
def test_infer_source(spark, names, want):
    assert infer_source(names) == want
    files = spark.createDataFrame([(f"up/{name}" if "/" not in name else name,) for name in names], "path string")
    if want not in ("google_health",) and "/" not in names[0]:
        assert classify_uploads(files).first().source == want


def test_unknown_sources(spark, tmp_path):
    with pytest.raises(ValueError, match="cannot tell"):
        infer_source(["notes.txt"])
    with pytest.raises(ValueError, match="not supported"):
        parse_files(spark, ["a.csv"], "abacus")


def test_header_index(spark, tmp_path):
    """Headers by file: after blank lines, a byte order mark or a title, said twice, of other widths and orders; names that Spark escapes."""
    from pulseframe.sources.csv_files import header_index, read_by_header

    files = {
        "a/one.csv": "Id,Day,x\n1,2,3\n",
        "a/b c+d.csv": '\ufeff\n\n"x", Id ,Day\n"p, q",5,6,7\nId,9\n\n8\n',
        "c/part-1.csv": "Day,x,Id,x\nm,n,o,p\nDay,x,Id,x\n",
        "c/none.csv": "1,2\n3,4\n",
        "c/empty.csv": "",
        "c/blank.csv": "\n \n",
    }
    for name, text in files.items():
        write(tmp_path / name, text)
    (tmp_path / "long").mkdir()
    write(tmp_path / "long" / "big.csv", "Id,Day\n" + "".join(f"{i},2033-01-01 and some padding\n" for i in range(300_000)))
    folders = [str(tmp_path / name) for name in ("a", "c", "long")]

    def is_header(names):
        return F.array_contains(names, "Id") & F.array_contains(names, "Day")

    index = {r.file.rsplit("/", 1)[1]: r.header.lstrip("\ufeff") for r in header_index(spark, folders, "day", is_header).collect()}
    assert index == {"one.csv": "Id,Day,x", "b%20c+d.csv": '"x", Id ,Day', "part-1.csv": "Day,x,Id,x", "big.csv": "Id,Day"}
    rows, headless = read_by_header(spark, folders[:2], ["Id", "Day", "x", "y"], "day", is_header)
    assert sorted((tuple(r) for r in rows.collect()), key=str) == sorted(
        [("1", "2", "3", None), ("5", "6", "p, q", None), ("9", None, "Id", None), (None, None, "8", None), ("o", "m", "p", None)], key=str
    )
    assert sorted(r.file.rsplit("/", 1)[1] for r in headless.collect()) == ["blank.csv", "none.csv"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        rows, _ = read_by_header(spark, folders[2:], ["Id", "y"], "day", is_header)
        assert rows.count() == 300_000 and rows.agg(F.countDistinct("Id")).first()[0] == 300_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
