"""Registered queries: a Spark plan and, where SQL can express it, its DuckDB oracle.

``register(name, sql)`` records a callable ``(spark, sf_dir) -> DataFrame``.
``rounding`` rounds the named double columns on both sides so that a
different summation order cannot change the compared values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def round_cols(df: DataFrame, rounding: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), s) for c, s in rounding.items()})


def round_sql(sql: str, rounding: dict[str, int]) -> str:
    if not rounding:
        return sql
    repl = ", ".join(f"round({c}, {s}) AS {c}" for c, s in rounding.items())
    return f"SELECT * REPLACE ({repl}) FROM ({sql}) AS q"


def register(name: str, sql: str | None = None, rounding: dict[str, int] | None = None):
    rounding = rounding or {}

    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_cols(fn(spark, sf_dir), rounding)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = round_sql(sql, rounding)
        return fn
    return deco
