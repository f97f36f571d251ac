"""D-01…D-09: calendar, cyclic, lag, rolling, growth and ratio features.

All frames run over one window spec (``series_window``), so the whole
feature block is one Exchange on the series keys and one sort; the
back-fill of units/price adds a second in-partition sort, no shuffle.
A series is a window partition of *periods*, so its size is bounded by
the calendar (months or days covered), not by the number of fact rows; raw
rows that weren't rolled up go through ``long_features``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from panelcast.operators.common import backfill, series_window, series_window_desc, whole_series

# ML feature list, in model input order (fixed values).
FEATURE_COLUMNS = [
    "month", "quarter", "year", "day_of_year",
    "month_sin", "month_cos",
    "lag_1", "lag_2", "lag_3",
    "rolling_mean_3", "rolling_std_3", "rolling_mean_6",
    "units_sold", "price",
]

RATIO_EPS = 1e-9
# Rows that a feature looks back and ahead (a head null is filled from three rows on).
ROWS_BACK, ROWS_AHEAD = 6, 3


def raw_features(panel: DataFrame, w: WindowSpec, row_idx: Column, has_price: Column) -> DataFrame:
    """Calendar, lags, rolling frames, growth and ratio over one ordered window, before any filling."""
    rev = F.col("revenue")
    lag1 = F.lag(rev, 1).over(w)
    month = 2 * math.pi * F.month("date") / 12
    return panel.select(
        *panel.columns,
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.quarter("date").alias("quarter"),
        F.dayofyear("date").alias("day_of_year"),
        F.sin(month).alias("month_sin"),
        F.cos(month).alias("month_cos"),
        lag1.alias("lag_1"),
        F.lag(rev, 2).over(w).alias("lag_2"),
        F.lag(rev, 3).over(w).alias("lag_3"),
        F.avg(rev).over(w.rowsBetween(-3, -1)).alias("rolling_mean_3"),
        F.coalesce(F.stddev_samp(rev).over(w.rowsBetween(-3, -1)), F.lit(0.0)).alias("rolling_std_3"),
        F.avg(rev).over(w.rowsBetween(-ROWS_BACK, -1)).alias("rolling_mean_6"),
        (F.try_divide(rev - lag1, lag1) * 100).alias("growth_rate"),
        F.when(has_price, rev / (F.col("price") + RATIO_EPS)).alias("price_revenue_ratio"),
        row_idx.alias("row_idx"),
        lag1.alias("_base"))


def without_head(stage: DataFrame) -> DataFrame:
    """``fill="drop"``; positions count the rows that stay: splits, folds and smoothing rely on them."""
    stage = stage.filter(F.col("row_idx") >= 3).withColumn("row_idx", F.col("row_idx") - 3)
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in
              ("lag_1", "lag_2", "lag_3", "rolling_mean_3", "rolling_mean_6", "growth_rate", "units_sold", "price")}
    return stage.withColumns(filled).drop("_base")


def head_filled(w: WindowSpec) -> dict[str, Column]:
    """Head nulls sit in the first k rows, so the next non-null value is at most k rows
    ahead: bounded frames over the same spec, no extra sort."""
    ahead = {"lag_1": 1, "lag_2": 2, "lag_3": ROWS_AHEAD, "rolling_mean_3": 1, "rolling_mean_6": 1}
    return {c: F.coalesce(F.first(c, ignorenulls=True).over(w.rowsBetween(0, k)), F.lit(0.0)) for c, k in ahead.items()}


def growth_to_fill() -> Column:
    undefined = (F.col("row_idx") == 0) | F.coalesce((F.col("_base") == 0) & (F.col("revenue") == 0), F.lit(False))
    return F.col("growth_rate").isNull() & undefined


def add_features(panel: DataFrame, keys: Sequence[str] = (), fill: str = "bfill") -> DataFrame:
    """Features per row of a clean panel.

    ``fill="bfill"`` reproduces the reference: head nulls are back-filled
    (so row 0's ``lag_1`` is its own revenue) and what stays null becomes 0.
    ``fill="drop"`` drops the first three rows of each series instead and
    zero-fills the rest, which avoids that leak.
    """
    if fill not in ("bfill", "drop"):
        raise ValueError("fill must be 'bfill' or 'drop'")
    keys = list(keys)
    w = series_window(panel, keys)
    has_price = F.max("price").over(whole_series(keys)) > 0
    stage = raw_features(panel, w, (F.row_number().over(w) - 1).cast("int"), has_price)
    if fill == "drop":
        return without_head(stage)
    filled = head_filled(series_window(stage, keys))
    # Growth is null on row 0 and for 0 after 0 (both back-filled), and after a
    # zero base otherwise: that has no finite value and stays null.
    wd0 = series_window_desc(stage, keys)
    filled["growth_rate"] = F.when(
        growth_to_fill(), F.coalesce(backfill("growth_rate", wd0), F.lit(0.0))
    ).otherwise(F.col("growth_rate"))
    stage = stage.withColumns(filled).drop("_base")
    # Units, price and the ratio can hold nulls anywhere in raw panels.
    wd = series_window_desc(stage, keys)
    tail = {c: F.coalesce(backfill(c, wd), F.lit(0.0))
            for c in ("units_sold", "price")}
    # The ratio exists only for series with some positive price (else NULL).
    tail["price_revenue_ratio"] = F.when(
        F.max("price").over(whole_series(keys)) > 0,
        F.coalesce(backfill("price_revenue_ratio", wd), F.lit(0.0)))
    return stage.withColumns(tail)
