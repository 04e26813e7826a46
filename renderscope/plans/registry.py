"""Registered queries: a Spark job and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def round_as_sql(value: Column, places: int = 6) -> Column:
    """Half away from zero of the binary product, as the SQL rounds; Spark's round goes by the printed decimals."""
    return F.round(value * 10.0**places) / 10.0**places


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    binary = {f.name for f in df.schema if f.dataType == T.DoubleType()}
    return df.withColumns(
        {c: round_as_sql(F.col(c), places) if c in binary else F.round(c, places) for c in columns}
    )
