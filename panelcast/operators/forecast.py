"""G-02…G-12: forecast rows per series, band, KPIs and display tables.

A forecast is one row per (series, step). The smoothing path (G-07) is a
closed form over ``explode(sequence(1, H))`` of the per-series state: no
loop, no join. The model path (G-01) lives in ``recursive.py``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.dates import add_periods
from panelcast.functions.numbers import money

# Band multiplier and its widening per step.
Z_BAND = 1.28
BAND_WIDENING = 0.08
DEFAULT_HORIZON = 6


def band(forecast: Column, rmse: Column, step: Column, z: float = Z_BAND) -> tuple[Column, Column]:
    """G-08: half-width rmse·z·(1 + 0.08·(step−1)); both sides clamped at 0."""
    half = rmse * z * (1 + BAND_WIDENING * (step - 1))
    return (F.greatest(F.lit(0.0), forecast - half), F.greatest(F.lit(0.0), forecast + half))


def finish(rows: DataFrame, keys: Sequence[str], z: float = Z_BAND) -> DataFrame:
    """Band, clamp and 2-dp rounding (G-06, G-08, G-09) over raw predictions.

    ``rows`` holds keys, step, date, ``_value`` (unclamped), ``_rmse``.
    """
    keys = list(keys)
    value = F.greatest(F.lit(0.0), F.col("_value"))
    lo, hi = band(value, F.col("_rmse"), F.col("step"), z)
    extra = [c for c in rows.columns if c not in set(keys) | {"step", "date", "_value", "_rmse"}]
    return rows.select(*keys, "step", "date",
                       F.round(value, 2).alias("forecast"),
                       F.round(lo, 2).alias("lower"),
                       F.round(hi, 2).alias("upper"), *extra)


def es_forecast(state: DataFrame, keys: Sequence[str] = (), horizon: int = DEFAULT_HORIZON,
                z: float = Z_BAND, noise_seed: int | None = None,
                keep: Sequence[str] = ("last_actual",), grain: str = "month") -> DataFrame:
    """G-02, G-07: level·(1+g)^i for i = 1…H from ``es_fit`` state.

    ``noise_seed`` adds N(0, 0.15·rmse) per step as the reference does
    (its noise is unseeded; ours is seeded and off by default). ``grain`` is the
    distance of the forecast dates (day, week, month, quarter or year).
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    keys = list(keys)
    g = F.coalesce(F.col("growth"), F.lit(0.0))
    rows = state.select(*keys, *keep, "last_date", "last_smooth", "rmse", g.alias("_g"),
                        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    value = F.col("last_smooth") * F.pow(1 + F.col("_g"), F.col("step").cast("double"))
    if noise_seed is not None:
        value = value + F.randn(noise_seed) * F.col("rmse") * 0.15
    rows = rows.select(*keys, "step", add_periods(F.col("last_date"), F.col("step"), grain).alias("date"),
                       value.alias("_value"), F.col("rmse").alias("_rmse"), *keep)
    return finish(rows, keys, z)


def forecast_kpis(forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """G-10: total, next, final and growth of the final step vs the last actual."""
    keys = list(keys)
    k = forecast.groupBy(*keys).agg(
        F.sum("forecast").alias("total_forecast"),
        F.min_by("forecast", "step").alias("next_forecast"),
        F.max_by("forecast", "step").alias("final_forecast"),
        F.first("last_actual").alias("last_actual"))
    return k.withColumn("period_growth", F.try_divide(
        F.col("final_forecast") - F.col("last_actual"), F.col("last_actual")) * 100)


def overlay(history: DataFrame, forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """G-11: history and forecast as one long table, plus the band outline.

    The outline runs forward along ``upper`` then back along ``lower`` so a
    plot can fill it as one closed shape; ``ord`` is its drawing order
    (0 on history rows, which are ordered by date).
    """
    keys = list(keys)
    hist = history.select(*keys, F.lit("history").alias("kind"), "date",
                          F.col("revenue").alias("value"), F.lit(0).alias("ord"))
    fc = forecast.select(*keys, F.lit("forecast").alias("kind"), "date",
                         F.col("forecast").alias("value"), F.col("step").alias("ord"))
    h = F.max("step").over(Window.partitionBy(*keys))
    up = forecast.select(*keys, F.lit("band").alias("kind"), "date", F.col("upper").alias("value"),
                         F.col("step").alias("ord"))
    down = forecast.select(*keys, F.lit("band").alias("kind"), "date", F.col("lower").alias("value"),
                           (2 * h + 1 - F.col("step")).cast("int").alias("ord"))
    return hist.unionByName(fc).unionByName(up).unionByName(down)


def forecast_table(forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """G-12: display table with ``MMM yyyy`` months and whole-dollar amounts."""
    keys = list(keys)
    return forecast.select(*keys, "step", F.date_format("date", "MMM yyyy").alias("month"),
                           money(F.col("forecast")).alias("forecast"),
                           money(F.col("lower")).alias("lower"),
                           money(F.col("upper")).alias("upper"))
