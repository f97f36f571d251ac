"""T-01…T-06: is a revenue target reachable at a forecast step?

Targets are a table ``(keys…, step, target)``; the check is an equi-join
on (keys, step) with the forecast, so any number of targets is checked in
one pass. ``with_default_target`` derives the default per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.numbers import filled, money

# Default target factor and verdict labels.
DEFAULT_TARGET_FACTOR = 1.1
VERDICT_YES = "YES - Easily Achievable"
VERDICT_MAYBE = "MAYBE - Achievable with Effort"
VERDICT_NO = "NO - Beyond Forecast Range"
# Texts of the verdict; the oracle reads them too.
NOTE_YES = "Forecast revenue of %s is %.1f%% above the target."
NOTE_MAYBE = "The target lies between the forecast and the top of its band, %s."
NOTE_NO = "The target is %s higher than the top of the band."
REC_YES = "Stay on the current course."
REC_MAYBE = "Look for extra demand before the period starts."
REC_NO = "Lower the target, or change price or volume."


def with_default_target(forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """T-01 as window columns on the forecast itself: ``target`` = 1.1 × the
    series' mean forecast, ``is_check_step`` marks its last step. One pass
    over the forecast, no join back."""
    keys = list(keys)
    series = Window.partitionBy(*keys)
    return forecast.withColumns({
        "target": F.avg("forecast").over(series) * DEFAULT_TARGET_FACTOR,
        "is_check_step": F.col("step") == F.max("step").over(series)})


def check_default_targets(forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """T-01…T-05 with the default target of each series."""
    keys = list(keys)
    staged = with_default_target(forecast, keys).filter("is_check_step")
    return _verdicts(staged, keys)


def check_targets(forecast: DataFrame, targets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """T-02…T-05 for each target row; ``forecast`` must carry ``last_actual``."""
    keys = list(keys)
    return _verdicts(targets.join(forecast, keys + ["step"]), keys)


def _verdicts(j: DataFrame, keys: list[str]) -> DataFrame:
    t, fv, uv = F.col("target"), F.col("forecast"), F.col("upper")
    verdict = F.when(t <= fv, "YES").when(t <= uv, "MAYBE").otherwise("NO")
    v = F.col("verdict")
    return j.withColumn("verdict", verdict).select(
        *keys, "step", F.concat(F.lit("Month "), F.col("step").cast("string")).alias("period"),
        "target", "forecast", "lower", "upper", "verdict",
        F.when(v == "YES", VERDICT_YES).when(v == "MAYBE", VERDICT_MAYBE)
        .otherwise(VERDICT_NO).alias("label"),
        F.try_divide(t - F.col("last_actual"), F.col("last_actual")).alias("_g"),
        F.when(v == "YES", F.try_divide(fv - t, t) * 100).alias("margin_pct"),
        F.when(v == "NO", t - uv).alias("shortfall"),
        F.when(v == "YES", filled(NOTE_YES, money(fv), F.try_divide(fv - t, t) * 100))
        .when(v == "MAYBE", filled(NOTE_MAYBE, money(uv)))
        .otherwise(filled(NOTE_NO, money(t - uv))).alias("note"),
        F.when(v == "YES", REC_YES).when(v == "MAYBE", REC_MAYBE)
        .otherwise(REC_NO).alias("recommendation"),
    ).withColumn("required_growth", F.col("_g") * 100).drop("_g")


def target_per_period(forecast: DataFrame, targets: DataFrame | None = None,
                      keys: Sequence[str] = ()) -> DataFrame:
    """T-06: every step against its series' target: a join on keys, and on the
    step where the targets have one; the default target needs no join."""
    keys = list(keys)
    if targets is None:
        staged = with_default_target(forecast, keys)
    else:
        on = keys + (["step"] if "step" in targets.columns else [])
        if on:
            staged = forecast.join(targets.select(*on, "target"), on)
        else:  # one series and one target for all its steps
            rows = targets.select("target").limit(2).collect()
            if len(rows) != 1:
                raise ValueError("one series takes one target; give a step for several")
            staged = forecast.withColumn("target", F.lit(rows[0][0]).cast("double"))
    return staged.select(*keys, "step", "date", "forecast", "target",
                         (F.col("forecast") >= F.col("target")).alias("meets_target"))
