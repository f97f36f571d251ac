"""M-01, M-04, M-12, M-13, M-15: pooled training, cross-validation, leaderboard.

All series are pooled into one training set; hold-out rows and CV folds are
assigned by position *within* each series (``with_splits``), so every
series contributes to every fit and no series' future leaks into its own
hold-out. The folds of linear models are solved from sums (``gram``); other
fits are independent Spark jobs and run from a small driver
thread pool (MLlib parallelises inside each fit). Fold statistics, metrics
and predictions are DataFrame aggregates; nothing is collected but a
handful of per-fold counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.features import FEATURE_COLUMNS
from panelcast.operators.gram import fold_fits, fold_moments, fold_predictions
from panelcast.operators.models import BOOST_ITERS, FOREST_TREES, LINEAR, MODEL_NAMES, RIDGE, RIDGE_ALPHA, build
from panelcast.operators.smoothing import ES_NAME, es_predictions, leaderboard, pooled_metrics
from panelcast.operators.splits import with_splits
from panelcast.session import ensure_checkpoint_dir

#: Partitions of the training data. Bagging is seeded per partition, so the number is the
#: caller's and never follows from a row count or the session.
PARTITIONS = 8
DEFAULT_PARALLELISM = 6


def feature_columns(df: DataFrame) -> list[str]:
    """M-01: the model features present in ``df``, in fixed order."""
    return [c for c in FEATURE_COLUMNS if c in df.columns]


def assemble(features: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Vector column with missing values as 0 (G-05), plus split/fold labels."""
    keys = list(keys)
    staged = with_splits(features, keys)
    filled = staged.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                                 for c in cols})
    vec = VectorAssembler(inputCols=[f"_f_{c}" for c in cols], outputCol="features")
    return vec.transform(filled).select(*keys, "date", "revenue", "features", "is_test", "fold",
                                        "row_idx", "n_rows")


@dataclass
class TrainResult:
    metrics: DataFrame
    predictions: DataFrame
    fitted: dict = field(default_factory=dict)
    feature_cols: list = field(default_factory=list)

    def best_name(self) -> str:
        return self.metrics.filter("is_best").select("name").first()[0]


def _label_stats(rows: list, keep) -> tuple[int, float]:
    n = sum(r["n"] for r in rows if keep(r))
    if n == 0:
        return 0, 0.0
    s = sum(r["s"] for r in rows if keep(r))
    ss = sum(r["ss"] for r in rows if keep(r))
    var = max(ss / n - (s / n) ** 2, 0.0)
    return n, math.sqrt(var)


def train_models(features: DataFrame, keys: Sequence[str] = (), models: Sequence[str] = MODEL_NAMES,
                 cv: bool = True, include_es: bool = True, parallelism: int = DEFAULT_PARALLELISM,
                 cv_mode: str = "kfold", partitions: int = PARTITIONS, trees: int = FOREST_TREES,
                 iterations: int = BOOST_ITERS) -> TrainResult:
    """Fit every model on the training split, cross-validate, rank.

    ``metrics``: one row per model with hold-out RMSE/MAE/R², CV means and
    population stds, ``cv_splits``, ``is_ts`` and the ranks of M-15/M-16.
    ``predictions``: hold-out rows ``(keys…, date, model, actual, predicted)``.
    Both are checkpointed to the shared checkpoint folder, so later use does
    not refit or re-read the sources.

    ``cv_mode="kfold"`` is the reference's contiguous K-fold (earlier folds
    are scored by models that saw later periods); ``"expanding"`` scores
    fold f with a model trained on folds before f only.
    """
    if cv_mode not in ("kfold", "expanding"):
        raise ValueError("cv_mode must be 'kfold' or 'expanding'")
    if not models and not include_es:
        raise ValueError("nothing to train: give models or include_es=True")
    keys = list(keys)
    spark = features.sparkSession
    ensure_checkpoint_dir(spark)
    cols = feature_columns(features)
    # The panel is small and read by every fit: written once to the shared folder.
    features = features.checkpoint(eager=True)
    order = [*keys, "date"]
    data = (assemble(features, keys, cols).repartition(partitions, *order).sortWithinPartitions(*order)
            .persist(StorageLevel.MEMORY_AND_DISK))

    # One small job: counts and label moments per (fold, is_test).
    stats = [r.asDict() for r in data.groupBy("fold", "is_test").agg(
        F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("s"),
        F.sum(F.col("revenue") ** 2).alias("ss")).collect()]
    folds = sorted({r["fold"] for r in stats if r["fold"] is not None}) if cv else []
    if cv_mode == "expanding":
        folds = [f for f in folds if f >= 1]
    expanding = cv_mode == "expanding"

    # Linear folds come from sums that one pass takes (``gram``); other models are fitted per fold.
    summed = {m: alpha for m, alpha in ((LINEAR, 0.0), (RIDGE, RIDGE_ALPHA)) if m in models} if folds else {}
    fitted_folds = [m for m in models if m not in summed]
    tasks = [(m, f) for m in fitted_folds for f in folds] + [(m, None) for m in models]

    def fit(task):
        name, fold = task
        if fold is None:
            train = data.filter(~F.col("is_test"))
            n, sd = _label_stats(stats, lambda r: not r["is_test"])
        elif expanding:
            train = data.filter(F.col("fold") < fold)
            n, sd = _label_stats(stats, lambda r: r["fold"] is not None and r["fold"] < fold)
        else:
            train = data.filter(F.col("fold").isNotNull() & (F.col("fold") != fold))
            n, sd = _label_stats(stats, lambda r: r["fold"] is not None and r["fold"] != fold)
        est = build(name, len(cols), sd, n, trees=trees, iterations=iterations)
        return task, est.fit(train)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        fitted_all = dict(pool.map(fit, tasks))

    # Hold-out predictions of every model (and the smoother) are computed once
    # and checkpointed; all hold-out metrics are read from that checkpoint.
    hold = [fitted_all[(m, None)].transform(data.filter("is_test")).select(
        *keys, "date", F.lit(m).alias("model"), F.col("revenue").alias("actual"),
        F.col("prediction").alias("predicted")) for m in models]
    if include_es:
        hold.append(es_predictions(features, keys))
    predictions = _union(hold).checkpoint(eager=True)
    hold_metrics = pooled_metrics(predictions, by=["model"])

    if folds and models:
        cv_preds = [fitted_all[(m, f)].transform(data.filter(F.col("fold") == f)).select(
            F.lit(m).alias("model"), F.lit(f).alias("fold"),
            F.col("revenue").alias("actual"), F.col("prediction").alias("predicted"))
            for m in fitted_folds for f in folds]
        if summed:
            moments = fold_moments(data, len(cols))
            fits = {m: fold_fits(moments, folds, alpha, expanding) for m, alpha in summed.items()}
            cv_preds.append(fold_predictions(data, fits).select("model", "fold", "actual", "predicted"))
        per_fold = pooled_metrics(_union(cv_preds), by=["model", "fold"])
        cv_summary = per_fold.groupBy("model").agg(
            F.avg("rmse").alias("cv_rmse_mean"), F.stddev_pop("rmse").alias("cv_rmse_std"),
            F.avg("mae").alias("cv_mae_mean"), F.stddev_pop("mae").alias("cv_mae_std"),
            F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"),
            F.count(F.lit(1)).cast("int").alias("cv_splits"))
        joined = hold_metrics.join(cv_summary, "model", "left")
    else:
        joined = hold_metrics.select("*", *[F.lit(None).cast("double").alias(c) for c in (
            "cv_rmse_mean", "cv_rmse_std", "cv_mae_mean", "cv_mae_std", "cv_r2_mean", "cv_r2_std")],
            F.lit(None).cast("int").alias("cv_splits"))
    # M-14: models without CV (the smoother, or cv=False) copy the hold-out
    # metrics into the CV fields, with zero spread and zero splits.
    no_cv = F.col("cv_splits").isNull()
    ml = joined.select(
        F.col("model").alias("name"), "rmse", "mae", "r2",
        F.when(no_cv, F.col("rmse")).otherwise(F.col("cv_rmse_mean")).alias("cv_rmse_mean"),
        F.when(no_cv, F.lit(0.0)).otherwise(F.col("cv_rmse_std")).alias("cv_rmse_std"),
        F.when(no_cv, F.col("mae")).otherwise(F.col("cv_mae_mean")).alias("cv_mae_mean"),
        F.when(no_cv, F.lit(0.0)).otherwise(F.col("cv_mae_std")).alias("cv_mae_std"),
        F.when(no_cv, F.col("r2")).otherwise(F.col("cv_r2_mean")).alias("cv_r2_mean"),
        F.when(no_cv, F.lit(0.0)).otherwise(F.col("cv_r2_std")).alias("cv_r2_std"),
        F.coalesce(F.col("cv_splits"), F.lit(0)).alias("cv_splits"),
        (F.col("model") == ES_NAME).alias("is_ts"), "n_test")
    metrics = leaderboard(ml).checkpoint(eager=True)
    data.unpersist()
    fitted = {m: fitted_all[(m, None)] for m in models}
    return TrainResult(metrics=metrics, predictions=predictions, fitted=fitted, feature_cols=cols)


def series_metrics(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hold-out RMSE/MAE/R² per (model, series): the band width per series."""
    return pooled_metrics(predictions, by=["model", *keys])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
