from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as driver

FOLDER = os.path.dirname(driver.SMALLEST) + "/sf0.001"


def rounded(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


def as_rows(columns, rows):
    names = sorted(columns)
    at = [list(columns).index(n) for n in names]
    return names, sorted(tuple(repr(rounded(r[k])) for k in at) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = driver.queries()[name](spark, FOLDER)
    got = as_rows(df.columns, df.collect())
    found = duck.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert got == as_rows(columns, found.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() == 10


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
