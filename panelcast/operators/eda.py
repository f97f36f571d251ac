"""E-01…E-13: exploratory aggregates per series.

Each function is one hash aggregate (partial + final) or one window pass
on the series keys; none collects a series to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.numbers import filled
from panelcast.operators.common import order_cols

# Columns of the correlation matrix, in display order (fixed values).
CORR_COLUMNS = ["revenue", "units_sold", "price", "growth_rate", "lag_1"]


# Texts of the observations; the oracle reads them too.
NOTE_PEAK = "Best month on average: %s."
NOTE_GROWTH = "Mean change from one period to the next: %+.1f%% (%s)."
TREND_UP, TREND_DOWN = "rising", "not rising"
NOTE_SPREAD = "Spread of revenue around its mean: %.1f%%. %s"
SPREAD_WIDE, SPREAD_NARROW = "Periods differ a lot.", "Periods are alike."


def _summary_aggs(features: DataFrame) -> list:
    rev = F.col("revenue")
    has_growth = "growth_rate" in features.columns
    return [
        F.count(F.lit(1)).alias("n_periods"),
        F.sum(rev).alias("total_revenue"),
        F.avg(rev).alias("mean_revenue"),
        F.max(rev).alias("peak_revenue"),
        F.min(rev).alias("min_revenue"),
        F.stddev_samp(rev).alias("std_revenue"),
        (F.try_divide(F.stddev_pop(rev), F.avg(rev)) * 100).alias("cv_pct"),
        (F.coalesce(F.avg("growth_rate"), F.lit(0.0)) if has_growth else F.lit(0.0)).alias("avg_growth"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
    ]


def summary(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """E-01…E-04, E-13 in one aggregate per series."""
    return features.groupBy(*keys).agg(*_summary_aggs(features))


def moving_average(features: DataFrame, keys: Sequence[str] = (), window: int = 3) -> DataFrame:
    """E-05: trailing mean incl. the current row, only for series with ≥ window rows."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(*order_cols(features))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ma = F.when(n >= window, F.avg("revenue").over(w.rowsBetween(-(window - 1), 0)))
    return features.select(*keys, "date", "revenue", ma.alias(f"ma_{window}"))


def month_label(month_col) -> F.Column:
    return F.date_format(F.make_date(F.lit(2000), month_col, F.lit(1)), "MMM")


def seasonality(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """E-06: mean revenue by calendar month, with its label."""
    keys = list(keys)
    month = F.month("date")
    return (features.groupBy(*keys, month.alias("month"))
            .agg(F.avg("revenue").alias("avg_revenue"))
            .withColumn("month_name", month_label(F.col("month"))))


def peak_month(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """E-07: month with the highest mean revenue; ties go to the earlier month."""
    keys = list(keys)
    s = seasonality(features, keys)
    return s.groupBy(*keys).agg(
        F.max_by("month_name", F.struct(F.col("avg_revenue"), -F.col("month"))).alias("peak_month"),
        F.max("avg_revenue").alias("peak_avg_revenue"))


def trendline(features: DataFrame, keys: Sequence[str] = (), x: str = "units_sold",
              y: str = "revenue") -> DataFrame:
    """E-08: OLS y ~ x per series (NULL slope for a constant x)."""
    keys = list(keys)
    return features.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"))


def correlation(features: DataFrame, keys: Sequence[str] = (),
                columns: Sequence[str] = CORR_COLUMNS) -> DataFrame:
    """E-09: Pearson matrix over the present columns, long form (x, y, corr)."""
    keys = list(keys)
    cols = [c for c in columns if c in features.columns]
    aggs = [F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]
    wide = features.groupBy(*keys).agg(*aggs)
    entries = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{i}_{j}").alias("corr"))
               for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return wide.select(*keys, F.inline(F.array(*entries)))


def observations(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """E-10: three rule-based notes per series (peak month, growth sign, volatility).

    The monthly means ride along as a window column, so the summary and the
    peak month come out of one aggregate with no join.
    """
    keys = list(keys)
    by_month = Window.partitionBy(*keys, F.month("date"))
    staged = features.withColumns({
        "_month": F.month("date"),
        "_mavg": F.avg("revenue").over(by_month)})
    s = staged.groupBy(*keys).agg(
        *_summary_aggs(features),
        F.max_by(month_label(F.col("_month")),
                 F.struct(F.col("_mavg"), -F.col("_month"))).alias("peak_month"))
    g, cv = F.col("avg_growth"), F.col("cv_pct")
    notes = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("info").alias("type"),
                 filled(NOTE_PEAK, F.col("peak_month")).alias("text")),
        F.struct(F.lit(2).alias("seq"), F.when(g > 0, "success").otherwise("danger").alias("type"),
                 filled(NOTE_GROWTH, g,
                                 F.when(g > 0, TREND_UP).otherwise(TREND_DOWN)).alias("text")),
        F.struct(F.lit(3).alias("seq"), F.when(cv > 20, "warning").otherwise("success").alias("type"),
                 filled(NOTE_SPREAD, cv,
                                 F.when(cv > 20, SPREAD_WIDE).otherwise(SPREAD_NARROW)).alias("text")),
    )
    return s.select(*keys, F.inline(notes))


def sparkline(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """E-11: min, max, first→last change (0 when first is 0), last value, arrow."""
    keys = list(keys)
    order = F.struct(*[F.col(c) for c in order_cols(clean)])
    first = F.min_by("revenue", order)
    last = F.max_by("revenue", order)
    stats = clean.groupBy(*keys).agg(F.min("revenue").alias("min_revenue"),
                                     F.max("revenue").alias("max_revenue"),
                                     first.alias("first_revenue"), last.alias("last_revenue"))
    pct = F.when(F.col("first_revenue") == 0, F.lit(0.0)).otherwise(
        (F.col("last_revenue") - F.col("first_revenue")) / F.col("first_revenue") * 100)
    return stats.withColumn("pct_change", pct).withColumn(
        "arrow", F.when(F.col("pct_change") >= 0, "↑").otherwise("↓"))


# Data-health bands (lower bound, label), best first.
HEALTH_BANDS = [(85, "Excellent"), (65, "Good"), (0, "Needs Work")]


def data_health(raw: DataFrame, clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """E-12: 100·clean/raw rows, half-even rounded, clamped to 0…100, banded.

    Both inputs are tagged and unioned, then counted in one aggregate.
    """
    keys = list(keys)
    both = (raw.select(*keys, F.lit(True).alias("_raw"))
            .unionByName(clean.select(*keys, F.lit(False).alias("_raw"))))
    c = both.groupBy(*keys).agg(F.count_if("_raw").alias("raw_rows"),
                                F.count_if(~F.col("_raw")).alias("clean_rows"))
    completeness = F.least(F.lit(100.0), F.col("clean_rows") * 100.0 /
                           F.greatest(F.col("raw_rows"), F.lit(1)))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(completeness, 0).cast("int")))
    label = F.when(F.col("score") >= HEALTH_BANDS[0][0], HEALTH_BANDS[0][1]) \
        .when(F.col("score") >= HEALTH_BANDS[1][0], HEALTH_BANDS[1][1]).otherwise(HEALTH_BANDS[2][1])
    return c.withColumn("score", score).withColumn("label", label)
