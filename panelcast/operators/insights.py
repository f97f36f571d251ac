"""J-01…J-07: rule-based insight texts from importance and model quality.

Inputs are unioned into one tagged long table and reduced by a single
aggregate (importance rows are at most one per feature), so there is no
join between one-row frames. Texts are plain ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.numbers import filled, money

# Rule thresholds.
PRICE_HIGH, PRICE_DANGER = 10.0, 15.0
R2_EXCELLENT, R2_GOOD = 0.9, 0.75
ERROR_CONFIDENT = 10.0
# Texts; the oracle reads them too.
T_NONE = "There is no feature importance to report."
T_METHOD = "Importance by %s: each feature's mean share in the predictions."
T_FIRST = "%s matters most, with %.1f%% of the importance."
T_SECOND = "%s comes second with %.1f%%; the first two make up %.1f%%."
T_SEASON = "Calendar features hold %.1f%% of the importance, so peaks follow the season."
T_MOMENTUM = "Past revenue (lags and rolling means) holds %.1f%%, so near-term forecasts lean on it."
T_PRICE = "Price holds %.1f%% of the importance. %s"
T_PRICE_HIGH = "Revenue reacts strongly to price; try changes on a small scale first."
T_PRICE_LOW = "Revenue reacts little to price."
T_QUALITY = "The model is %s (R2 %.3f); its hold-out error is %.1f%% of mean revenue.%s %s"
T_CV = " Cross-validation gives an RMSE of %s +/- %s."
T_SURE, T_UNSURE = "The forecast can be relied on.", "More data would help."
SEASON_WORDS = "season|month|quarter"
MOMENTUM_WORDS = "lag|rolling"


def _imp(cond: Column, value: Column) -> Column:
    return F.when((F.col("kind") == "imp") & cond, value)


def insights(importance: DataFrame, best: DataFrame, features: DataFrame) -> DataFrame:
    """``importance``: normalised (feature, importance, rank, method);
    ``best``: the best model's metrics row; ``features``: the data (mean revenue).
    """
    name = F.lower(F.col("feature"))
    imp = importance.select(F.lit("imp").alias("kind"), "feature", "importance", "rank",
                            F.col("method").alias("text"))
    met = best.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("feature"),
                 F.col(k).cast("double").alias("importance"), F.lit(None).cast("int").alias("rank"),
                 F.lit(None).cast("string").alias("text"))
        for k in ("r2", "rmse", "cv_rmse_mean", "cv_rmse_std")])))
    rev = features.agg(F.avg("revenue").alias("importance")).select(
        F.lit("mean_revenue").alias("kind"), F.lit(None).cast("string").alias("feature"),
        "importance", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("text"))
    long = imp.unionByName(met).unionByName(rev)

    def metric(k: str) -> Column:
        return F.max(F.when(F.col("kind") == k, F.col("importance")))

    r = long.agg(
        F.count_if(F.col("kind") == "imp").alias("n"),
        F.max(_imp(F.lit(True), F.col("text"))).alias("method"),
        F.max(_imp(F.col("rank") == 1, F.col("feature"))).alias("f1"),
        F.max(_imp(F.col("rank") == 1, F.col("importance"))).alias("i1"),
        F.max(_imp(F.col("rank") == 2, F.col("feature"))).alias("f2"),
        F.max(_imp(F.col("rank") == 2, F.col("importance"))).alias("i2"),
        F.sum(_imp(name.rlike(SEASON_WORDS), F.col("importance"))).alias("season"),
        F.sum(_imp(name.rlike(MOMENTUM_WORDS), F.col("importance"))).alias("momentum"),
        F.min_by(_imp(name.contains("price"), F.col("importance")),
                 _imp(name.contains("price"), F.col("rank"))).alias("price"),
        metric("r2").alias("r2"), metric("rmse").alias("rmse"),
        metric("cv_rmse_mean").alias("cv_rmse"), metric("cv_rmse_std").alias("cv_std"),
        metric("mean_revenue").alias("avg"))
    c = F.col
    pct_err = F.when(c("avg") > 0, c("rmse") / c("avg") * 100).otherwise(F.lit(0.0))
    quality = F.when(c("r2") > R2_EXCELLENT, "excellent").when(c("r2") > R2_GOOD, "good") \
        .otherwise("moderate")
    cv_note = F.when(c("cv_rmse") > 0, filled(T_CV, money(c("cv_rmse")), money(c("cv_std")))).otherwise("")
    entries = [
        (1, F.lit("warning"), F.lit(T_NONE), c("n") == 0),
        (2, F.lit("info"), filled(T_METHOD, c("method")),
         (c("n") > 0) & c("method").isNotNull()),
        (3, F.lit("info"), filled(T_FIRST, c("f1"), c("i1")), c("n") > 0),
        (4, F.lit("info"), filled(T_SECOND, c("f2"), c("i2"), c("i1") + c("i2")),
         c("f2").isNotNull()),
        (5, F.lit("warning"), filled(T_SEASON, c("season")), c("season").isNotNull()),
        (6, F.lit("success"), filled(T_MOMENTUM, c("momentum")),
         c("momentum").isNotNull()),
        (7, F.when(c("price") > PRICE_DANGER, "danger").otherwise("info"), filled(
            T_PRICE, c("price"), F.when(c("price") > PRICE_HIGH, T_PRICE_HIGH).otherwise(T_PRICE_LOW)),
         c("price").isNotNull()),
        (8, F.when(c("r2") > R2_GOOD, "success").otherwise("warning"), filled(
            T_QUALITY, quality, c("r2"), pct_err, cv_note, F.when(pct_err < ERROR_CONFIDENT, T_SURE).otherwise(T_UNSURE)),
         c("n") > 0),
    ]
    arr = F.array(*[F.struct(F.lit(i).alias("seq"), t.alias("type"), x.alias("text"),
                             keep.alias("_keep")) for i, t, x, keep in entries])
    return r.select(F.inline(arr)).filter("_keep").drop("_keep")
