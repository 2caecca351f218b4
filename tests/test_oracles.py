"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from quirelake.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return "nan" if isinstance(value, float) and math.isnan(value) else round(float(value), 4)
    return str(value)


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert ours == sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
