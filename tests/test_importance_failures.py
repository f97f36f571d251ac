"""A query whose model can't be scored fails; it shows no weights in place of a result."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelcast.operators import attribution as A
from panelcast.operators import importance as I
from panelcast.operators.features import add_features
from panelcast.operators.models import FOREST, LINEAR
from panelcast.operators.training import train_models
from panelcast.plans import analysis, queries_ml
from panelcast.plans.catalog import QUERIES
from panelcast.sources import fixtures as fx

#: Query, model, and what scores the model there.
SCORED = [
    ("importance_by_brand", LINEAR, I, "permutation_importance"),
    ("importance_linear_by_brand", LINEAR, I, "linear_attribution"),
    ("importance_dependent_linear_by_brand", LINEAR, A, "mean_size"),
    ("importance_shapley_by_brand", FOREST, I, "shapley_importance"),
    ("importance_tree_by_brand", FOREST, A, "mean_size"),
    ("insights_by_brand", LINEAR, I, "permutation_importance"),
    ("report_lines_by_brand", LINEAR, I, "permutation_importance"),
]


@pytest.fixture(scope="module")
def trained(spark, sf_small):
    feats = add_features(fx.sales_by_brand(spark, sf_small), ["series_key"])
    return train_models(feats, ["series_key"], models=[LINEAR, FOREST], cv=False, include_es=False, trees=2)


@pytest.fixture
def broken(spark, trained, monkeypatch):
    """The queries' model set, with scoring that fails as a Spark job does."""
    def put(best, module, scorer):
        metrics = trained.metrics.withColumn("is_best", F.col("name") == best)
        tr = type(trained)(metrics=metrics, predictions=trained.predictions, fitted=trained.fitted, feature_cols=trained.feature_cols)
        monkeypatch.setattr(queries_ml, "trained", lambda spark, sf: tr)
        monkeypatch.setattr(module, scorer, lambda *a, **k: spark.range(1).select(
            F.lit("lag_1").alias("feature"), F.raise_error(F.lit("not scored")).cast("double").alias("importance"), F.lit("none").alias("method")))
    return put


@pytest.mark.parametrize("name,best,module,scorer", SCORED, ids=[s[0] for s in SCORED])
def test_a_model_that_cannot_be_scored_fails_the_query(spark, sf_small, broken, name, best, module, scorer):
    broken(best, module, scorer)
    with pytest.raises(PySparkException, match="not scored"):
        QUERIES[name](spark, sf_small).collect()


def test_run_fails_too(spark, sf_small, monkeypatch):
    monkeypatch.setattr(I, "permutation_importance", lambda *a, **k: spark.range(1).select(
        F.lit("lag_1").alias("feature"), F.raise_error(F.lit("not scored")).cast("double").alias("importance"), F.lit("none").alias("method")))
    monkeypatch.setattr(analysis, "train_models", lambda *a, **k: train_models(*a, **k, include_es=False))
    with pytest.raises(PySparkException, match="not scored"):
        analysis.run(fx.sales_by_brand(spark, sf_small), ["series_key"], horizon=1, models=[LINEAR], cv=False)
