from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from test_sources import ACTIVITY, MANUAL, SLEEP, write

from pulseframe.operators import daily_overview
from pulseframe.plans import EventStore
from pulseframe.plans.store import load_sample_overview
from pulseframe.sources import load_events
from pulseframe.streaming import import_new_files


@pytest.fixture
def store(spark, tmp_path):
    return EventStore(spark, str(tmp_path / "store"))


@pytest.fixture
def sample(tmp_path):
    folder = tmp_path / "raw"
    write(folder / "dailyActivity_merged.csv", ACTIVITY)
    write(folder / "sleepDay_merged.csv", SLEEP)
    write(folder / "notes.csv", MANUAL)
    return str(folder)


def test_empty_store(store):
    assert not store.has_events()
    store.refresh()
    assert store.overview().count() == 0 and store.pairs().count() == 0
    assert store.users().count() == 0 and store.latest_user().count() == 0
    assert store.latest_user_overview().count() == 0


def test_import_twice_doubles_sums(store, sample):
    paths = [f"{sample}/dailyActivity_merged.csv", f"{sample}/sleepDay_merged.csv"]
    audit = store.import_files(paths, "fitbit")
    assert (audit["source"], audit["file_count"], audit["record_count"], audit["user_count"]) == ("fitbit", 2, 32, 1)
    store.import_files(paths, "fitbit")
    store.refresh()
    assert store.import_runs().count() == 2 and store.raw_events().count() == 64
    assert [r.steps for r in store.overview("walker-7").collect()] == [15600.0, 24800.0, 10300.0, 19800.0]
    assert store.import_users().count() == 2


def test_same_import_id_replaces(store, sample):
    for _ in range(2):
        store.import_files([f"{sample}/notes.csv"], "manual", import_id="again")
    store.refresh()
    assert store.raw_events().count() == 3 and store.import_runs().count() == 1
    assert store.overview().first().steps == 7300.0


def test_refresh_from_totals_equals_rebuild(store, sample):
    store.import_files([f"{sample}/dailyActivity_merged.csv"], "fitbit")
    store.import_files([f"{sample}/sleepDay_merged.csv"], "fitbit")
    store.refresh()
    quick = [r.asDict() for r in store.overview().drop("updated_at").orderBy("day").collect()]
    pairs = store.pairs().drop("updated_at").orderBy("metric_a", "metric_b").collect()
    store.refresh(rebuild=True)
    assert [r.asDict() for r in store.overview().drop("updated_at").orderBy("day").collect()] == quick
    assert store.pairs().drop("updated_at").orderBy("metric_a", "metric_b").collect() == pairs and len(pairs) == 12


def test_a_stopped_refresh_leaves_the_old_tables(store, sample, tmp_path, monkeypatch):
    paths = [f"{sample}/dailyActivity_merged.csv", f"{sample}/sleepDay_merged.csv"]
    store.import_files(paths, "fitbit")
    store.refresh()
    overview, pairs = (sorted(map(str, frame.collect())) for frame in (store.overview(), store.pairs()))
    reader = store.overview()
    store.import_files(paths, "fitbit")
    write = EventStore._write_derived

    def stop(self, frame, table, version):
        if table == "correlation_pairs":
            raise KeyboardInterrupt
        return write(self, frame, table, version)

    with monkeypatch.context() as patch:
        patch.setattr(EventStore, "_write_derived", stop)
        with pytest.raises(KeyboardInterrupt):
            store.refresh()
    assert sorted(map(str, store.overview().collect())) == overview and sorted(map(str, store.pairs().collect())) == pairs
    store.refresh()
    assert store.overview().first().steps != reader.first().steps  # a reader of the version before goes on
    assert sorted(map(str, store.overview().collect())) != overview
    folders = [f.name for f in (tmp_path / "store" / "derived").iterdir() if f.is_dir()]
    assert len(folders) == 2  # the current version and the one before


def test_known_events_are_skipped(store, sample, tmp_path):
    paths = [f"{sample}/dailyActivity_merged.csv", f"{sample}/sleepDay_merged.csv"]
    store.import_files(paths, "fitbit", skip_known=True)
    copy = write(tmp_path / "copy" / "sleepDay_merged.csv", SLEEP)
    assert store.import_files([copy], "fitbit", skip_known=True)["record_count"] == 0
    assert store.import_runs().count() == 1 and store.raw_events().count() == 32
    mixed = write(tmp_path / "more" / "notes.csv", MANUAL)
    assert store.import_files([mixed, f"{sample}/notes.csv"], "manual", skip_known=True)["record_count"] == 3  # the same file twice at once
    assert store.import_files([mixed], "manual", skip_known=False)["record_count"] == 3


def _parts(folder):
    return len([p for p in folder.rglob("*.parquet") if "import_id=" in str(p) or "merged" in str(p)])


def _contents(store):
    tables = store.raw_events(), store.import_runs(), store.day_totals(), store.quarantine()
    return [sorted((tuple(row[name] for name in sorted(frame.columns)) for row in frame.collect()), key=str) for frame in tables]


def test_compaction_keeps_all_rows_in_few_files(store, sample, tmp_path):
    """Many imports, merged twice; set-aside rows and an import without usable rows, too."""
    assert store.compact() == 0
    for n in range(4):
        store.import_files([write(tmp_path / f"m{n}.csv", MANUAL.replace("ada", f"u{n}") + "soon,mood,1,,,me\n")], "manual", f"first-{n}")
    with pytest.raises(ValueError, match="no usable"):
        store.import_files([write(tmp_path / "none.csv", "timestamp,metric,value\nsoon,mood,1\n")], "manual", "unusable")
    before = _contents(store)
    assert store.compact() == 4
    assert _contents(store) == before and store.raw_events("u2").count() == 3 and store.quarantine().count() == 5
    store.refresh()
    overview = [row[:-1] for row in store.overview().orderBy("source_user_id").collect()]
    store.import_files([f"{sample}/dailyActivity_merged.csv"], "fitbit", "second")
    before = _contents(store)
    assert store.compact() == 1 and _contents(store) == before
    assert store.compact(most_generations=1) == 0 and _contents(store) == before
    assert store.compact() == 0 and _contents(store) == before
    assert _parts(tmp_path / "store") <= 8  # raw rows in two folders, totals, runs, and those of the unusable import
    store.refresh(rebuild=True)
    assert [row[:-1] for row in store.overview().where("source_user_id like 'u%'").orderBy("source_user_id").collect()] == overview


def test_imports_repeated_after_compaction(store, sample, tmp_path, monkeypatch):
    """A repeated import replaces its merged rows only when it is complete; it is merged by the next run."""
    path = write(tmp_path / "m.csv", MANUAL)
    store.import_files([path], "manual", "one")
    store.import_files([f"{sample}/sleepDay_merged.csv"], "fitbit", "two")
    store.compact()
    before = _contents(store)
    write(tmp_path / "m.csv", MANUAL + "2033-01-21T06:30:00,steps,10,count,diary,ada\n")
    with monkeypatch.context() as stopped:
        stopped.setattr("pulseframe.plans.store.daily_partials", lambda events: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.import_files([path], "manual", "one")
    assert _contents(store) == before
    for _ in range(2):
        store.import_files([path], "manual", "one")
        assert store.raw_events().count() == 12 and store.import_runs().count() == 2
    assert store.compact() == 1
    assert store.raw_events().count() == 12 and store.import_runs().count() == 2
    assert store.import_runs().where("import_id = 'one'").first().record_count == 4


def test_a_stopped_compaction_changes_nothing(store, sample, tmp_path, monkeypatch):
    for n in range(2):
        store.import_files([write(tmp_path / f"m{n}.csv", MANUAL)], "manual", f"i{n}")
    before = _contents(store)
    for name in ("replace_small_file", "delete_folders"):
        with monkeypatch.context() as stopped:
            stopped.setattr(f"pulseframe.plans.store.{name}", lambda *args, **kw: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                store.compact()
        assert _contents(store) == before
    assert store.compact() == 0 and _contents(store) == before


def test_scans(store, sample, spark):
    store.import_files([f"{sample}/dailyActivity_merged.csv", f"{sample}/sleepDay_merged.csv"], "fitbit")
    store.import_files([f"{sample}/notes.csv"], "manual")
    store.refresh()
    assert store.raw_events("ada").count() == 3
    assert [r.day.day for r in store.overview("walker-7").collect()] == [9, 10, 11, 12]
    strengths = [abs(r.correlation) for r in store.pairs("walker-7").collect()]
    assert strengths == sorted(strengths, reverse=True)
    assert store.pairs("walker-7", lag_days=1).count() == 6 and store.pairs("walker-7", lag_days=0).count() == 6
    assert [r[0] for r in store.users().collect()] == ["ada", "walker-7"]
    assert store.latest_user_overview().first().source_user_id == "ada"


def test_no_usable_rows_is_an_error(store, tmp_path):
    path = write(tmp_path / "bad.csv", "timestamp,metric,value\nsoon,steps,1\n")
    with pytest.raises(ValueError, match="no usable events"):
        store.import_files([path], "manual")
    assert store.import_runs().count() == 0 and not store.has_events()


def test_bad_rows_are_set_aside(store, tmp_path):
    path = write(tmp_path / "mixed.csv", "timestamp,metric,value\n2024-01-01,steps,1\nsoon,steps,1\n2024-01-01,steps,x\n")
    assert store.import_files([path], "manual")["record_count"] == 1
    assert sorted(r.reject_reason for r in store.quarantine().collect()) == ["timestamp", "value"]


def test_bootstrap_only_into_an_empty_store(store, sample):
    assert store.bootstrap_sample(sample)["record_count"] == 32
    assert store.bootstrap_sample(sample) is None
    assert store.raw_events().count() == 32 and store.overview().count() == 4


def test_bootstrap_with_one_or_no_file(store, tmp_path, sample):
    empty = tmp_path / "none"
    write(empty / "readme.txt", "x")
    assert store.bootstrap_sample(str(empty)) is None
    write(empty / "sleepDay_merged.csv", SLEEP)
    assert store.bootstrap_sample(str(empty))["record_count"] == 8


def test_load_sample_overview(spark, sample, tmp_path):
    overview = load_sample_overview(spark, sample, str(tmp_path / "other"))
    assert [round(r.health_score, 3) for r in overview.collect()] == [66.454, 64.25, 55.112, 70.508]


def test_stream_picks_up_each_file_once(spark, store, tmp_path):
    landing, checkpoint = tmp_path / "landing", str(tmp_path / "checkpoint")
    write(landing / "one two" / "dailyActivity_merged.csv", ACTIVITY)
    write(landing / "a" / "notes.csv", MANUAL)
    write(landing / "a" / "readme.txt", "ignored")
    import_new_files(spark, str(landing), store, checkpoint)
    assert store.raw_events().count() == 27 and store.import_runs().count() == 2
    import_new_files(spark, str(landing), store, checkpoint)
    assert store.raw_events().count() == 27
    write(landing / "b" / "sleepDay_merged.csv", SLEEP)
    ring = {"user_id": "r", "activity": [{"day": "2033-01-21", "steps": 5}]}
    write(landing / "b" / "oura.json", json.dumps(ring))
    import_new_files(spark, str(landing), store, checkpoint, files_per_batch=1)
    assert store.raw_events().count() == 36 and store.import_runs().count() == 4
    direct = load_events(spark, [str(landing / "one two" / "dailyActivity_merged.csv"), str(landing / "b" / "sleepDay_merged.csv")], "fitbit")
    want = daily_overview(direct).select("day", "health_score").orderBy("day").collect()
    assert store.overview("walker-7").select("day", "health_score").collect() == want


def test_repeated_batch_counts_once(spark, store, tmp_path):
    """A batch whose commit was lost is run again on restart and replaces its own rows."""
    landing, checkpoint = tmp_path / "landing", tmp_path / "checkpoint"
    write(landing / "notes.csv", MANUAL)
    import_new_files(spark, str(landing), store, str(checkpoint))
    for name in ("0", ".0.crc"):
        (checkpoint / "commits" / name).unlink()
    import_new_files(spark, str(landing), store, str(checkpoint))
    assert store.raw_events().count() == 3 and store.import_runs().count() == 1
    assert store.overview().agg(F.sum("steps")).first()[0] == 7300.0


def test_unreadable_files_do_not_hold_up_the_stream(spark, store, tmp_path):
    landing, checkpoint = tmp_path / "landing", str(tmp_path / "checkpoint")
    write(landing / "good.csv", MANUAL)
    write(landing / "bad.csv", "date,unit\n2024-01-01,x\n")
    write(landing / "oura_bad.json", '{"user_id": "x", "sleep": [')
    write(landing / "takeout_bad.json", "{ not json")
    write(landing / "b" / "sleepDay_merged.csv", "who,when\n1,2\n")
    import_new_files(spark, str(landing), store, checkpoint)
    assert store.raw_events().count() == 3 and store.import_runs().count() == 1
    reasons = sorted((r.source, r.reject_reason) for r in store.quarantine().collect())
    assert reasons == [("fitbit", "header"), ("google_health", "document"), ("manual", "header"), ("oura", "document")]
    named = store.quarantine().where("source = 'manual'").first().metadata_json
    assert json.loads(named)["file"].endswith("/landing/bad.csv")
