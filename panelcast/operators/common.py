"""Shared window specs and column helpers for panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def order_cols(df: DataFrame) -> list[str]:
    """Series order: ``date``, then ``seq`` (original row position) when present."""
    return ["date", "seq"] if "seq" in df.columns else ["date"]


def series_window(df: DataFrame, keys: Sequence[str]) -> WindowSpec:
    """The one window spec every per-series operator shares.

    All frames over it reuse a single Exchange on ``keys`` plus one sort, so
    lags, rolling frames and row numbers cost one shuffle in total.
    """
    return Window.partitionBy(*keys).orderBy(*order_cols(df))


def series_window_desc(df: DataFrame, keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_cols(df)])


def whole_series(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def backfill(col: str | Column, w_desc: WindowSpec) -> Column:
    """Next non-null value at or after the current row (pandas ``bfill``).

    A running frame over the descending order is evaluated in one pass, unlike
    a ``currentRow..unboundedFollowing`` frame that is recomputed per row.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.last(c, ignorenulls=True).over(
        w_desc.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def nan_to_null(c: Column) -> Column:
    """Spark keeps NaN apart from NULL; the data model has NULL only."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
