"""M-10, M-11, M-12, M-14: exponential smoothing per series, closed form.

The recursion s ← α·y + (1−α)·s from s₀ = y₀ equals
Σ yᵢ·wᵢ with w₀ = (1−α)^(n−1) and wᵢ = α(1−α)^(n−1−i), so the level is one
weighted sum per series: a window aggregate over the series partition,
no loop and no per-series task beyond the partition itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.common import order_cols
from panelcast.operators.splits import with_splits

# Smoothing factor and the damping of the mean growth.
ALPHA = 0.3
GROWTH_DAMPING = 0.65
ES_NAME = "Exp. Smoothing (TS)"


def _staged(features: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    s = with_splits(features, keys)
    whole = Window.partitionBy(*keys)
    w = Window.partitionBy(*keys).orderBy(*order_cols(s))
    rn, split = F.col("row_idx"), F.col("split_idx")
    train = ~F.col("is_test")
    weight = F.when(train, F.when(rn == 0, F.lit(1.0)).otherwise(F.lit(alpha)) *
                    F.pow(F.lit(1.0 - alpha), (split - 1 - rn).cast("double")))
    rev = F.col("revenue")
    prev = F.lag(rev, 1).over(w)
    s = s.withColumns({
        "level": F.sum(rev * weight).over(whole),
        "_pct": F.try_divide(rev - prev, prev),
        "_test_mean": F.avg(F.when(F.col("is_test"), rev)).over(whole),
    })
    return s.withColumn("_err", F.when(F.col("is_test"), rev - F.col("level")))


def es_fit(features: DataFrame, keys: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """One row per series: smoothing state and its hold-out metrics.

    ``last_smooth`` is the level after the training rows (M-11, same value
    as the M-10 prediction); ``growth`` is the damped mean period growth
    used by the forecast (G-07); rmse/mae/r2 are on the hold-out tail.
    """
    keys = list(keys)
    s = _staged(features, keys, alpha)
    e = F.col("_err")
    order = F.struct(*[F.col(c) for c in order_cols(s)])
    ss_tot = F.sum(F.when(F.col("is_test"), F.pow(F.col("revenue") - F.col("_test_mean"), 2)))
    last = {c: F.max_by(c, order).alias(f"last_{c}") for c in ("units_sold", "price")
            if c in s.columns}
    return s.groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"),
        F.max("split_idx").alias("n_train"),
        F.max("date").alias("last_date"),
        F.max_by("revenue", order).alias("last_actual"),
        *last.values(),
        F.first("level").alias("last_smooth"),
        (F.avg("_pct") * GROWTH_DAMPING).alias("growth"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), ss_tot)).alias("r2"),
    )


def es_predictions(features: DataFrame, keys: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """M-13 for the smoother: hold-out rows with the flat level as prediction."""
    keys = list(keys)
    s = _staged(features, keys, alpha).filter("is_test")
    return s.select(*keys, "date", F.lit(ES_NAME).alias("model"),
                    F.col("revenue").alias("actual"), F.col("level").alias("predicted"))


def pooled_metrics(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """M-12 over hold-out rows: RMSE, MAE, R² per group of ``by``, in one pass.

    The total sum of squares is ``var_pop(actual)·n``, which Spark accumulates
    with a stable streaming update, so no mean has to be computed first: one
    hash aggregate with partial sums, whatever the number of groups.
    """
    by = list(by)
    e = F.col("actual") - F.col("predicted")
    ss_tot = F.var_pop("actual") * F.count("actual")
    return predictions.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), ss_tot)).alias("r2"),
        F.count(F.lit(1)).alias("n_test"))


def es_metrics(features: DataFrame, keys: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """M-14: the smoother's leaderboard row (CV fields copy the hold-out)."""
    m = pooled_metrics(es_predictions(features, keys, alpha))
    return m.select(
        F.col("model").alias("name"), "rmse", "mae", "r2",
        F.col("rmse").alias("cv_rmse_mean"), F.lit(0.0).alias("cv_rmse_std"),
        F.col("mae").alias("cv_mae_mean"), F.lit(0.0).alias("cv_mae_std"),
        F.col("r2").alias("cv_r2_mean"), F.lit(0.0).alias("cv_r2_std"),
        F.lit(0).alias("cv_splits"), F.lit(True).alias("is_ts"), "n_test")


def leaderboard(metrics: DataFrame) -> DataFrame:
    """M-15, M-16: rank by CV RMSE (best first) and by hold-out RMSE.

    The metrics table has one row per model, so the global window is small.
    """
    by_cv = Window.orderBy(F.col("cv_rmse_mean").asc_nulls_last(), "name")
    by_hold = Window.orderBy(F.col("rmse").asc_nulls_last(), "name")
    return metrics.withColumns({
        "rank": F.row_number().over(by_cv).cast("int"),
        "rank_holdout": F.row_number().over(by_hold).cast("int"),
    }).withColumns({"is_best": F.col("rank") == 1,
                    "is_best_holdout": F.col("rank_holdout") == 1})
