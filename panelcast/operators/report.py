"""H-01…H-04, H-06, H-07: report sections as tables of formatted text.

Sections are DataFrames ``(keys…, line_no, label, value)`` or plain
tables; ``panelcast.sources.sinks`` writes them. Money uses ``$#,##0.00``
(half-even, like Python's format); plain decimals drop the separators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.numbers import fixed



def money2(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def money0(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))


def iso_day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# Summary section labels in report order.
SUMMARY_LABELS = ["Total Periods", "Total Revenue", "Average Revenue", "Max Revenue",
                  "Min Revenue", "Std Dev", "Start Date", "End Date"]


def summary_section(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """H-01 (E-13 formatted): one aggregate per series, stacked to label/value rows."""
    keys = list(keys)
    rev = F.col("revenue")
    a = clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(rev), 4).alias("total"), F.round(F.avg(rev), 4).alias("mean"),
        F.round(F.max(rev), 4).alias("max"), F.round(F.min(rev), 4).alias("min"), F.stddev_samp(rev).alias("std"),
        F.min("date").alias("start"), F.max("date").alias("end"))
    values = [F.col("n").cast("string"), money2(F.col("total")), money2(F.col("mean")),
              money2(F.col("max")), money2(F.col("min")), money2(F.col("std")),
              iso_day(F.col("start")), iso_day(F.col("end"))]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("line_no"), F.lit(lbl).alias("label"),
                              v.alias("value")) for i, (lbl, v) in enumerate(zip(SUMMARY_LABELS, values))])
    return a.select(*keys, F.inline(rows))


def model_section(metrics: DataFrame) -> DataFrame:
    """H-03: name, RMSE/MAE (2 dp), R² (4 dp), CV RMSE, best-by-hold-out flag (M-16)."""
    return metrics.select(
        F.col("name").alias("model"), fixed(F.col("rmse"), 2).alias("rmse"),
        fixed(F.col("mae"), 2).alias("mae"), fixed(F.col("r2"), 4).alias("r2"),
        money0(F.coalesce(F.col("cv_rmse_mean"), F.col("rmse"))).alias("cv_rmse"),
        (F.col("rank_holdout") == 1).alias("best_holdout"))


def forecast_section(forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """H-04: ISO date and the three amounts."""
    keys = list(keys)
    return forecast.select(*keys, "step", iso_day(F.col("date")).alias("date"),
                           "forecast", "lower", "upper")


def importance_section(importance: DataFrame, top_k: int = 8) -> DataFrame:
    """Importance rows for the report (the first ``top_k`` drivers), % to 1 dp."""
    return importance.filter(F.col("rank") <= top_k).select(
        "rank", "feature", F.format_string("%s%%", fixed(F.col("importance"), 1)).alias("importance"))


def target_section(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """H-07: the six target fields as label/value rows."""
    keys = list(keys)
    fields = [("Target Revenue", money0(F.col("target"))),
              ("ML Forecast", money0(F.col("forecast"))),
              ("Forecast Upper CI", money0(F.col("upper"))),
              ("Forecast Lower CI", money0(F.col("lower"))),
              ("Growth Required", F.concat(F.when(F.col("required_growth") >= 0, "+").otherwise(""),
                                           fixed(F.col("required_growth"), 1), F.lit("%"))),
              ("Check Period", F.col("period"))]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("line_no"), F.lit(lbl).alias("label"),
                              v.alias("value")) for i, (lbl, v) in enumerate(fields)])
    return checks.select(*keys, F.inline(rows))


def run_summary(data: DataFrame, metrics: DataFrame, forecast: DataFrame) -> DataFrame:
    """H-06: data points, best model's first word, its R², forecast total.

    Three one-row aggregates are unioned as tagged values and reduced once.
    """
    pts = data.agg(F.count(F.lit(1)).cast("double").alias("v")).select(
        F.lit("points").alias("k"), F.lit(None).cast("string").alias("s"), "v")
    best = metrics.filter("is_best").select(
        F.lit("best").alias("k"), F.split(F.col("name"), " ")[0].alias("s"),
        F.col("r2").alias("v"))
    tot = forecast.agg(F.sum("forecast").alias("v")).select(
        F.lit("total").alias("k"), F.lit(None).cast("string").alias("s"), "v")
    u = pts.unionByName(best).unionByName(tot)
    r = u.agg(F.max(F.when(F.col("k") == "points", F.col("v"))).cast("long").alias("data_points"),
              F.max(F.when(F.col("k") == "best", F.col("s"))).alias("best_model"),
              F.max(F.when(F.col("k") == "best", F.col("v"))).alias("model_r2"),
              F.max(F.when(F.col("k") == "total", F.col("v"))).alias("forecast_total"))
    return r.withColumns({
        "data_points_text": F.format_number(F.col("data_points"), 0),
        "model_r2_text": fixed(F.col("model_r2"), 3),
        "forecast_total_text": F.concat(F.lit("$"), fixed(F.col("forecast_total") / 1000, 1),
                                        F.lit("k"))})
