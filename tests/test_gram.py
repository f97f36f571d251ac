"""Fold fits from sums against MLlib's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import gram
from panelcast.operators.features import add_features
from panelcast.operators.models import LINEAR, RIDGE, RIDGE_ALPHA, build
from panelcast.operators.training import assemble, feature_columns
from panelcast.sources import fixtures as fx


@pytest.fixture(scope="module")
def data(spark, sf_small):
    feats = add_features(fx.sales_by_brand(spark, sf_small), ["series_key"])
    return assemble(feats, ["series_key"], feature_columns(feats)).repartition(3).cache(), len(feature_columns(feats))


@pytest.mark.parametrize("expanding", [False, True])
@pytest.mark.parametrize("name,alpha", [(LINEAR, 0.0), (RIDGE, RIDGE_ALPHA)])
def test_same_as_a_fit_per_fold(spark, data, name, alpha, expanding):
    df, d = data
    moments = gram.fold_moments(df, d)
    folds = [f for f in sorted(moments) if f or not expanding]
    fits = gram.fold_fits(moments, folds, alpha, expanding)
    scored = gram.fold_predictions(df, {name: fits}, ["series_key", "date"])
    for f in folds[:2]:
        train = df.where(F.col("fold") < f if expanding else F.col("fold").isNotNull() & (F.col("fold") != f))
        n, sd = train.agg(F.count("*"), F.stddev_pop("revenue")).first()
        model = build(name, d, sd, n).fit(train)
        a = {(r["series_key"], r["date"]): r["predicted"] for r in scored.where(F.col("fold") == f).collect()}
        # Rows 0 to 2 break what makes the mean of three lags redundant; there MLlib's fits are one of many.
        same = df.where((F.col("fold") == f) & (F.col("row_idx") >= 3))
        c = {(r["series_key"], r["date"]): r["prediction"] for r in model.transform(same).collect()}
        assert a.keys() >= c.keys()
        top = max(map(abs, c.values()))
        np.testing.assert_allclose([a[k] for k in c], [c[k] for k in c], atol=1e-7 * top)
        rows = train.select("features", "revenue").collect()
        x, y = np.array([r[0].toArray() for r in rows]), np.array([r[1] for r in rows])
        # The least-norm solution of the rows themselves, the penalty as rows of their own.
        own = np.vstack([x - x.mean(axis=0), np.sqrt(alpha) * np.eye(d)])
        want = np.linalg.lstsq(own, np.r_[y - y.mean(), np.zeros(d)], rcond=1e-12)[0]
        x0 = np.array([r[0].toArray() for r in df.where(F.col("fold") == f).select("features").collect()])
        np.testing.assert_allclose(x0 @ fits[f][0], x0 @ want, atol=1e-4 * top)


def test_constant_and_repeated_features():
    rng = np.random.default_rng(0)
    x = rng.normal(size=50)
    z = np.column_stack([x, np.full(50, 7.0), x, 3 * x + 2])
    point = z.mean(axis=0)
    part = z - point
    m = gram.Moments(np.r_[50, part.sum(axis=0), (part.T @ part).ravel()], point)
    beta, b = m.fit()
    assert beta[1] == 0 and abs(beta[0] + beta[2] - 3) < 1e-9 and abs(b - 2) < 1e-9
    assert gram.Moments(np.zeros(21), np.zeros(4)).fit()[1] == 0.0
    half = gram.Moments(np.r_[25, part[:25].sum(axis=0), (part[:25].T @ part[:25]).ravel()], point)
    rest = gram.Moments(np.r_[25, part[25:].sum(axis=0), (part[25:].T @ part[25:]).ravel()], point)
    np.testing.assert_allclose((half + rest).flat, m.flat, atol=1e-12)
