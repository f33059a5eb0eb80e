"""Where queries are listed: each by its function's name, beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def derived(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A recorded table that the driver's tables lack, made of one of theirs by expressions that both engines know."""
    return rows.selectExpr(*[f"{e} AS {name}" for name, e in columns.items()])


def derived_sql(columns: dict[str, str], table: str = "events") -> str:
    return f"SELECT {', '.join(f'{e} AS {name}' for name, e in columns.items())} FROM {table}"


def query(sql: str | None = None):
    """Lists the function that follows."""

    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is listed twice")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
