"""The reference's nine steps over a panel, composed from the operators.

clean → features → train → forecast → targets → scenarios → importance →
insights → report. Each step is a lazy DataFrame; the only eager work is
what MLlib fits need and small checkpointed results (metrics, hold-out
predictions, recursive-forecast state).
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import attribution as A
from panelcast.operators import forecast as G
from panelcast.operators import importance as I
from panelcast.operators import report as H
from panelcast.operators import scenarios as K
from panelcast.operators import targets as T
from panelcast.operators.features import add_features
from panelcast.operators.insights import insights
from panelcast.operators.models import BOOST_ITERS, BOOSTING, FOREST, FOREST_TREES, LINEAR, MODEL_NAMES, RIDGE
from panelcast.operators.recursive import recursive_forecast
from panelcast.operators.smoothing import ES_NAME, es_fit
from panelcast.session import ensure_checkpoint_dir
from panelcast.operators.training import TrainResult, assemble, series_metrics, train_models


@dataclass
class Analysis:
    features: DataFrame
    training: TrainResult
    best: str
    forecast: DataFrame
    targets: DataFrame
    scenarios: DataFrame
    importance: DataFrame
    insights: DataFrame
    sections: dict = field(default_factory=dict)


def best_forecast(features: DataFrame, training: TrainResult, keys: Sequence[str] = (),
                  horizon: int = G.DEFAULT_HORIZON, model: str | None = None) -> DataFrame:
    """G-01/G-07: forecast with the best model (or ``model``), band from its
    per-series hold-out RMSE."""
    keys = list(keys)
    name = model or training.best_name()
    if name == ES_NAME:
        return G.es_forecast(es_fit(features, keys), keys, horizon)
    rmse = series_metrics(training.predictions.filter(F.col("model") == name), keys)
    return recursive_forecast(features, training.fitted[name], training.feature_cols, rmse, keys,
                              horizon)


def best_importance(features: DataFrame, training: TrainResult, keys: Sequence[str] = (),
                    model: str | None = None, method: str = "permutation",
                    samples: int = I.SHAPLEY_SAMPLES, fallback: bool = True) -> DataFrame:
    """I-01…I-06 → I-08: normalised top-10 importance of the chosen model.

    If scoring fails, ``fallback`` warns and gives uniform weights (I-07). Without it the
    failure is raised: queries and ``run`` never show weights that nothing was scored for.

    ``method="model"`` is what suits the model: path-dependent values for trees, values
    for dependent features for linear models, kernel values for others."""
    keys = list(keys)
    name = model or training.best_name()
    spark = features.sparkSession
    if name == ES_NAME:
        raw = I.heuristic_importance(spark, training.feature_cols)
    else:
        data = assemble(features, keys, training.feature_cols).filter(~F.col("is_test"))
        fitted = training.fitted[name]
        ids = [*keys, "date"]
        if method == "model":
            method = "tree" if name in (FOREST, BOOSTING) else "dependent" if name in (LINEAR, RIDGE) else "kernel"
        try:
            if method == "linear" and name in (LINEAR, RIDGE):
                raw = I.linear_attribution(fitted.coefficients.toArray().tolist(), data,
                                           training.feature_cols)
            elif method == "tree" and name in (FOREST, BOOSTING):
                raw = A.mean_size(A.tree_rows(A.node_table(fitted), data, training.feature_cols, ids), A.METHOD_TREE)
            elif method == "dependent" and name in (LINEAR, RIDGE):
                raw = A.mean_size(A.dependent_linear_rows(fitted.coefficients.toArray().tolist(), data, training.feature_cols, ids), A.METHOD_DEPENDENT)
            elif method == "kernel":
                raw = A.mean_size(A.kernel_rows(fitted, data, training.feature_cols, ids, samples=samples), A.METHOD_KERNEL)
            elif method == "shapley":
                raw = I.shapley_importance(I.shapley_sampling(
                    fitted, data, training.feature_cols, id_cols=ids, samples=samples))
            else:
                raw = I.permutation_importance(fitted, data, training.feature_cols, id_cols=ids)
            raw = raw.checkpoint(eager=True)  # one row per feature; a model that can't score fails here
        except (PySparkException, Py4JJavaError) as e:
            if not fallback:
                raise
            warnings.warn(f"{name} could not be scored, all features count alike: {e}", stacklevel=2)
            raw = I.uniform_importance(spark, training.feature_cols)
    return I.normalise(raw)


def run(panel: DataFrame, keys: Sequence[str] = (), horizon: int = G.DEFAULT_HORIZON,
        models: Sequence[str] = MODEL_NAMES, cv: bool = True, trees: int = FOREST_TREES, iterations: int = BOOST_ITERS,
        scenario_steps: tuple[int, int, int] = (5, 5, 10)) -> Analysis:
    keys = list(keys)
    ensure_checkpoint_dir(panel.sparkSession)
    panel = panel.checkpoint(eager=True)  # small; every section reads it
    features = add_features(panel, keys)
    training = train_models(features, keys, models=models, cv=cv, trees=trees, iterations=iterations)
    best = training.best_name()
    fc = best_forecast(features, training, keys, horizon)
    tg = T.check_default_targets(fc, keys)
    sc = K.impacts(fc, K.lever_grid(*scenario_steps), keys)
    imp = best_importance(features, training, keys, fallback=False)
    ins = insights(imp, training.metrics.filter("is_best"), features)
    sections = {
        "summary": H.summary_section(panel, keys),
        "models": H.model_section(training.metrics),
        "cleaned": panel,
        "forecast": H.forecast_section(fc, keys),
        "importance": H.importance_section(imp),
    }
    return Analysis(features, training, best, fc, tg, sc, imp, ins, sections)
