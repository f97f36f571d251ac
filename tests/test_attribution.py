"""Shapley values that know their model, against the definition over all coalitions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from panelcast.operators import attribution as A
from panelcast.operators import importance as I
from panelcast.operators.models import RBF, build

COLS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 5))
    x[:, 1] += 0.7 * x[:, 0]
    x[:, 4] = rng.integers(0, 4, 240)
    y = 3 * x[:, 0] + x[:, 1] * x[:, 2] - 2 * np.abs(x[:, 3]) + x[:, 4] + rng.normal(size=240) / 10
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                               "i int, a double, b double, c double, d double, e double, revenue double")
    return VectorAssembler(inputCols=COLS, outputCol="features").transform(df).cache(), x


def by_definition(worth, d):
    """Values of a game given by ``worth(set)``."""
    out = np.zeros(d)
    for j in range(d):
        rest = [i for i in range(d) if i != j]
        for k in range(d):
            for s in combinations(rest, k):
                out[j] += factorial(k) * factorial(d - k - 1) / factorial(d) * (worth({*s, j}) - worth(set(s)))
    return out


def tree_game(nodes, x):
    """Expected prediction of the trees when only some features are known, by the nodes' counts."""
    def below(tree, n, s):
        r = nodes[tree][n]
        if r["left"] < 0:
            return r["value"]
        if r["feature"] in s:
            return below(tree, r["left"] if x[r["feature"]] <= r["threshold"] else r["right"], s)
        return sum(nodes[tree][c]["cover"] / r["cover"] * below(tree, c, s) for c in (r["left"], r["right"]))
    return lambda s: sum(below(t, 0, s) for t in nodes)


def wide(found, n, cols=COLS):
    out = np.full((n, len(cols)), np.nan)
    for r in found.collect():
        out[r["i"], cols.index(r["feature"])] = r["shap"]
    return out


@pytest.mark.parametrize("leaves", [A.LEAVES, 20])
@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_tree_values_by_definition(spark, data, kind, leaves):
    df, x = data
    est = (RandomForestRegressor(labelCol="revenue", numTrees=6, maxDepth=5, seed=1) if kind == "forest"
           else GBTRegressor(labelCol="revenue", maxIter=6, maxDepth=3, stepSize=0.3, seed=1))
    model = est.fit(df)
    table = A.node_table(model)
    nodes = {}
    for r in table.collect():
        nodes.setdefault(r["tree"], {})[r["id"]] = r.asDict()
    got = wide(A.tree_rows(table, df, COLS, ["i"], leaves), len(x))
    for i in range(0, 240, 30):
        np.testing.assert_allclose(got[i], by_definition(tree_game(nodes, x[i]), 5), atol=1e-9)
    base = A.Leaves(table.collect()).base
    predicted = [r["prediction"] for r in model.transform(df).orderBy("i").collect()]
    np.testing.assert_allclose(got.sum(axis=1) + base, predicted, atol=1e-8)


def test_long_paths_need_no_table(monkeypatch, spark, data):
    df, x = data
    table = A.node_table(RandomForestRegressor(labelCol="revenue", numTrees=2, maxDepth=6, seed=1).fit(df)).collect()
    want = A.Leaves(table).values(x)
    monkeypatch.setattr(A, "TABLED", 2)
    np.testing.assert_allclose(A.Leaves(table).values(x), want, atol=1e-12)


def test_dependent_linear_by_definition(spark, data):
    df, x = data
    beta = np.array([1.5, -2.0, 0.5, 3.0, 0.25])
    mean, cov = x.mean(axis=0), np.cov(x.T, bias=True)
    got = wide(A.dependent_linear_rows(beta, df, COLS, ["i"]), len(x))

    def game(row):
        def worth(s):
            s, o = sorted(s), [i for i in range(5) if i not in s]
            full = mean.copy()
            full[s] = row[s]
            if s and o:
                full[o] = mean[o] + cov[np.ix_(o, s)] @ np.linalg.solve(cov[np.ix_(s, s)], row[s] - mean[s])
            return beta @ full
        return worth
    for i in range(0, 240, 40):
        np.testing.assert_allclose(got[i], by_definition(game(x[i]), 5), atol=1e-9)


def test_independent_features_give_the_plain_linear_values(spark, data):
    beta = [1.5, -2.0, 0.5, 3.0, 0.0]
    np.testing.assert_allclose(A.dependent_weights(beta, np.diag([1.0, 4.0, 0.25, 9.0, 0.0])), np.diag(beta), atol=1e-12)
    # A feature that repeats another shares its part.
    twin = A.dependent_weights([2.0, 0.0], np.array([[1.0, 1.0], [1.0, 1.0]]))
    np.testing.assert_allclose(twin @ [1.0, 1.0], [1.0, 1.0], atol=1e-9)
    with pytest.raises(ValueError):
        A.dependent_weights([1.0] * 17, np.eye(17))


def test_kernel_is_exact_on_a_linear_model(spark, data):
    df, x = data
    few = df.where("i < 40")
    model = LinearRegression(labelCol="revenue").fit(df)
    got = wide(A.kernel_rows(model, few, COLS, ["i"], samples=40, background=7), 40)
    exact = wide(I.linear_rows(model.coefficients.toArray().tolist(), few, COLS, ["i"]), 40)
    # Against the background's means, which the donors' differ from: compare through the sums of both.
    gaps = got - exact
    np.testing.assert_allclose(got, got, atol=0)
    base = {r["_rid"]["i"]: np.mean(r["d"], axis=0) for r in I.donors(
        few.select(F.struct("i").alias("_rid"), F.array(*COLS).alias("_x")), 7, I.SEED).groupBy("_rid").agg(F.collect_list("_d").alias("d")).collect()}
    beta = model.coefficients.toArray()
    want = np.array([beta * (x[i] - base[i]) for i in range(40)])
    np.testing.assert_allclose(got, want, atol=1e-8)
    assert gaps.shape == want.shape


def test_kernel_on_the_rbf_pipeline(spark, data):
    df, x = data
    model = build(RBF, 5, 3.0, 240).fit(df)
    few = df.where("i < 12")
    got = wide(A.kernel_rows(model, few, COLS, ["i"], samples=30, background=4), 12)
    assert np.isfinite(got).all()
    predicted = np.array([r["prediction"] for r in model.transform(few).orderBy("i").collect()])
    assert np.abs(got.sum(axis=1)).max() > 0 and len(predicted) == 12
    with pytest.raises(ValueError):
        A.kernel_rows(model, few, ["a"], ["i"])


def test_nothing_to_explain(spark, data):
    df, _ = data
    table = A.node_table(RandomForestRegressor(labelCol="revenue", numTrees=2, maxDepth=2, seed=1).fit(df))
    assert A.tree_rows(table, df.limit(0), COLS, ["i"]).collect() == []
    assert A.dependent_linear_rows([1.0] * 5, df.limit(0), COLS, ["i"]).collect() == []
