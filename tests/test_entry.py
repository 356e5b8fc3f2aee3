"""Every registered query against its SQL counterpart on the smallest given tables."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as contract
from pulseframe.verification.oracles import all_oracles
from pulseframe.verification.queries import all_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(value):
        return value.isoformat() if isinstance(value, dt.datetime) else repr(value)

    return sorted(tuple(text(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() > 0 and frame.columns[:2] == ["source_user_id", "day"]


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, database, name):
    frame = contract.queries()[name](spark, FOLDER)
    cursor = database.execute(contract.oracle_sql()[name])
    names = [column[0] for column in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    want = comparable(cursor.fetchall(), names)
    assert want and comparable(frame.collect(), frame.columns) == want
