"""The physical plans keep their shape: pruned scans, few exchanges, no cross joins."""

from __future__ import annotations

import re

import pytest

from pulseframe.operators import correlation_pairs, daily_overview
from pulseframe.plans import EventStore, overview_payload
from pulseframe.sources import read_activity_log

FOLDER = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning", text))


@pytest.fixture(scope="module")
def overview(spark):
    return daily_overview(read_activity_log(spark, FOLDER))


def test_overview_plan(overview):
    text = plan(overview)
    assert exchanges(text) == 2 and "CartesianProduct" not in text and "NestedLoop" not in text
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "props" not in schema and "event_type" in schema
    assert text.count("partial_sum") and "PythonUDF" not in text


def test_pairs_and_payload_add_no_exchange(overview):
    assert exchanges(plan(correlation_pairs(overview))) == 2
    assert exchanges(plan(overview_payload(overview))) == 2


def test_user_filter_reaches_the_files(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    store.append_events(read_activity_log(spark, FOLDER), "log", 1)
    text = plan(store.raw_events("7"))
    assert "EqualTo(source_user_id,7)" in text and "PartitionFilters" in text
    assert "source_user_id" not in re.search(r"ReadSchema: (\S+)", plan(store.raw_events().select("metric"))).group(1)
