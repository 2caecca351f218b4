"""Registry of named queries, and literal tables that both engines can read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the equivalent SQL if there is one."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SQL_TYPES = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


class Literal:
    """A small table given by its rows: a DataFrame for Spark, a common table expression for SQL."""

    def __init__(self, schema: str, *rows: tuple):
        self.schema, self.rows = schema, rows
        self.fields = [part.split() for part in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        kinds = [kind for _, kind in self.fields]
        rows = [tuple(float(v) if k == "double" and v is not None else v for k, v in zip(kinds, r, strict=True)) for r in self.rows]
        return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in self.fields))

    def cte(self, name: str) -> str:
        columns = ", ".join(f"CAST({n} AS {_sql_type(k)}) AS {n}" for n, k in self.fields)
        values = ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in self.rows)
        return f"{name} AS (SELECT {columns} FROM (VALUES {values}) AS v({', '.join(n for n, _ in self.fields)}))"


def _sql_type(kind: str) -> str:
    if kind.startswith("array<"):
        return _sql_type(kind[6:-1]) + "[]"
    return _SQL_TYPES[kind]


def _sql_value(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(_sql_value, value)) + "]"
    return repr(value)
