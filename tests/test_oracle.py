"""Every registered query against DuckDB on the smallest tables."""

import datetime as dt
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    got = table(frame.columns, frame.collect())
    text = entry.oracle_sql().get(name)
    if text is None:
        assert got[1]
        return
    cursor = duck.execute(text)
    assert got == table([c[0] for c in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
