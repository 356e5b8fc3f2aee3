"""Incremental refresh against a rebuild, and what a refresh reads and writes."""

from __future__ import annotations

import datetime as dt
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pulseframe.plans import EventStore
from pulseframe.plans.incremental import IncrementalTables, merged_moments, moments
from pulseframe.schema import EVENT, USER, WIDE_METRICS
from pulseframe.session import scratch

START = dt.date(2031, 1, 5)


def events(spark, cells):
    """cells: (user, day number, metric, value)."""
    rows = [(dt.datetime.combine(START + dt.timedelta(days=d), dt.time(8)), m, float(v), "u", "test", u, None) for u, d, m, v in cells]
    return spark.createDataFrame(rows, EVENT)


def random_days(draw, user, days):
    return [(user, d, m, draw.choice([draw.uniform(1, 9000), 70, 70.1])) for d in days for m in WIDE_METRICS if draw.random() < 0.8]


def same(left, right):
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        for name, x in a.asDict().items():
            y = b[name]
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (name, a, b)


def check(store, tables):
    """Equal to a full rebuild from the raw events."""
    store.refresh(rebuild=True)
    same(tables.overview().drop("updated_at").orderBy(USER, "day").collect(), store.overview().drop("updated_at").orderBy(USER, "day").collect())
    order = (USER, "metric_a", "metric_b", "lag_days")
    same(tables.pairs().orderBy(*order).collect(), store.pairs().drop("updated_at").orderBy(*order).collect())


@pytest.fixture
def store(spark, tmp_path):
    return EventStore(spark, str(tmp_path / "store"))


def files(folder: Path) -> dict[str, float]:
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_late_repeated_and_out_of_order_days(spark, store):
    draw = random.Random(3)
    tables = IncrementalTables(store, parts=4)
    assert tables.refresh() == []
    users = [f"user-{i}" for i in range(7)]  # three of them skip days
    deliveries = [
        [c for u in users for c in random_days(draw, u, range(0, 45, 1 + users.index(u) % 3))],
        [c for u in users[:3] for c in random_days(draw, u, range(45, 50))],  # going on
        random_days(draw, "user-0", [20]) + random_days(draw, "user-4", [60]),  # one late, one after a gap
        random_days(draw, "user-1", [49, 50]) + random_days(draw, "new", [3]),  # the last day again, a new user
        random_days(draw, "user-6", [-40, 44]) + random_days(draw, "new", [5, 4]),  # before the first day
    ]
    for k, cells in enumerate(deliveries):
        store.append_events(events(spark, cells), "test", 1, f"import-{k}")
        assert tables.refresh()
        if k % 2:
            check(store, tables)
    assert tables.refresh() == []
    store.append_events(events(spark, deliveries[1]), "test", 1, "again")  # the same file twice doubles its sums
    store.append_events(events(spark, random_days(draw, "user-2", [70, 71])), "test", 1, "more")
    tables.refresh()
    check(store, tables)
    assert tables.overview("user-2").count() == store.overview("user-2").count() > 0
    assert tables.pairs("user-2", 1).count() == store.pairs("user-2", 1).count() > 0


def test_constant_metrics_have_no_correlation(spark, store):
    tables = IncrementalTables(store, parts=2)
    for k in range(2):
        days = range(5 * k, 5 * k + 5)
        store.append_events(events(spark, [("u", d, m, v) for d in days for m, v in (("steps", 0.1), ("hrv", 30 + d), ("resting_hr", 60.7))]), "test", 1)
        tables.refresh()
        check(store, tables)
    assert {r.metric_a for r in tables.pairs().collect()} <= {"hrv"}


def test_a_delivery_rewrites_one_part(spark, store, tmp_path):
    draw = random.Random(5)
    tables = IncrementalTables(store, parts=8)
    users = [f"user-{i}" for i in range(30)]
    store.append_events(events(spark, [c for u in users for c in random_days(draw, u, range(70))]), "test", 1)
    assert tables.refresh() == list(range(8))
    root = tmp_path / "store" / "incremental"
    before = files(root)
    # Older overview rows are not read: those of other months are replaced by rubbish.
    part = spark.createDataFrame([("user-9",)], f"{USER} string").select(tables._part(F.col(USER))).first()[0]
    store.append_events(events(spark, [("user-9", 70, "steps", 4000), ("user-9", 71, "hrv", 40)]), "test", 1)
    old = [f for f in (root / "overview" / f"part={part}").rglob("*.parquet") if "month=2031-03" not in str(f)]
    kept = {f: f.read_bytes() for f in old}
    for f in old:
        f.write_bytes(b"rubbish")
    assert old and tables.refresh() == [part]
    for f, data in kept.items():
        f.write_bytes(data)
    changed = {f for f, time in files(root).items() if before.get(f) != time and str(root / f) not in map(str, old)}
    assert changed and all(f"part={part}/" in f or f.startswith("folded") for f in changed)
    assert all("month=2031-03" in f for f in changed if f.startswith("overview"))
    check(store, tables)


@pytest.mark.parametrize("step", ["_write_overview", "_write_state", "folded"])
def test_a_stopped_refresh_is_repeated(spark, store, monkeypatch, step):
    draw = random.Random(8)
    tables = IncrementalTables(store, parts=3)
    users = ["a", "b", "c", "d"]
    store.append_events(events(spark, [c for u in users for c in random_days(draw, u, range(40))]), "test", 1)
    tables.refresh()
    store.append_events(events(spark, random_days(draw, "a", [40, 41]) + random_days(draw, "b", [10])), "test", 1)

    class Stopped(Exception):
        pass

    def stop(*_):
        raise Stopped

    with monkeypatch.context() as patch:
        if step == "folded":
            done = IncrementalTables._write_state
            patch.setattr(IncrementalTables, "_write_state", lambda self, *a: (done(self, *a), stop()))
        else:
            patch.setattr(IncrementalTables, step, stop)
        with pytest.raises(Stopped):
            tables.refresh()
    assert tables.pending()
    tables.refresh()
    check(store, tables)


def test_moments_are_one_row_a_user(spark):
    """Moments of a user's pairs are one row, without an exchange for each pair; two of them merge to those of all samples."""
    draw = random.Random(4)
    rows = [(u, p, draw.uniform(-9, 9), draw.choice([1.5, draw.uniform(0, 5)]), s) for u in "abc" for p, s in ((0, 0), (0, 1), (3, 0), (7, 1)) for _ in range(draw.randrange(1, 9))]
    rows += [("old", 5, 0.1, 2.0, 0), ("old", 5, 0.1, 3.0, 0), ("new", 5, 0.1, 3.0, 1), ("a", 9, 0.1, 0.1, 0), ("a", 9, 0.1, 0.1, 0), ("a", 9, 0.1, 0.1, 1)]
    samples = spark.createDataFrame(rows, f"{USER} string, pair int, x double, y double, side int").repartition(3, USER)
    old, new, want = (moments(f.drop("side")) for f in (samples.where("side = 0"), samples.where("side = 1"), samples))
    plan = want._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the repartition above
    both = old.withColumnRenamed("moments", "old").join(new.withColumnRenamed("moments", "new"), USER, "full")
    got = {r[USER]: r.m for r in both.select(USER, merged_moments(F.col("old"), F.col("new")).alias("m")).collect()}
    assert sorted(got) == sorted({u for u, *_ in rows})
    for user, found in want.collect():
        assert [m.pair for m in got[user]] == [m.pair for m in found] == sorted({p for u, p, *_ in rows if u == user})
        same(got[user], found)
    assert next(m for m in got["a"] if m.pair == 9).xx == 0.0


def test_a_refresh_writes_rows_once_before_the_tables(spark, store):
    """Nothing but day totals, users, days and scored days is written on the way: overview and state come straight from the scored days."""
    tables = IncrementalTables(store, parts=2)
    root = Path(scratch(spark, "x")).parent
    before = set(root.glob("incremental-refresh-*"))
    store.append_events(events(spark, random_days(random.Random(2), "u", range(9))), "test", 1)
    tables.refresh()
    (made,) = set(root.glob("incremental-refresh-*")) - before
    assert {f.name for f in made.iterdir()} == {"totals", "users", "days", "scored"}
    check(store, tables)
