"""Splits, smoothing, forecasts, targets, scenarios: closed forms and brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators import forecast as G
from panelcast.operators import scenarios as K
from panelcast.operators import targets as T
from panelcast.operators.features import add_features
from panelcast.operators.models import LINEAR
from panelcast.operators.recursive import recursive_forecast
from panelcast.operators.smoothing import ALPHA, es_fit
from panelcast.operators.splits import with_splits
from panelcast.operators.training import series_metrics, train_models
from panelcast.sources import fixtures as fx


def _series(spark, values):
    pdf = pd.DataFrame({"date": pd.date_range("2021-01-01", periods=len(values), freq="MS"),
                        "revenue": values, "units_sold": 1.0, "price": 1.0})
    return spark.createDataFrame(pdf).withColumn("date", F.col("date").cast("timestamp_ntz"))


def _kfold_numpy(n, k):
    sizes = np.full(k, n // k)
    sizes[: n % k] += 1
    return np.repeat(np.arange(k), sizes)


@pytest.mark.parametrize("n", [5, 17, 20, 24, 37])
def test_splits_match_numpy(spark, n):
    got = with_splits(add_features(_series(spark, [float(i + 1) for i in range(n)]), []), []) \
        .orderBy("date").toPandas()
    split = max(int(n * (1 - 0.2)), n - 6)
    assert got["is_test"].tolist() == [i >= split for i in range(n)]
    k = 5 if n >= 20 else 3
    assert got["fold"].tolist() == _kfold_numpy(n, k).tolist()


def test_short_series_has_no_fold(spark):
    got = with_splits(add_features(_series(spark, [1.0, 2.0]), []), []).toPandas()
    assert got["fold"].isna().all()


def test_smoothing_closed_form_equals_ewm(spark):
    values = [100.0, 120.0, 90.0, 130.0, 125.0, 140.0, 150.0, 135.0, 160.0, 170.0]
    st = es_fit(add_features(_series(spark, values), []), []).first()
    n = len(values)
    split = max(int(n * 0.8), n - 6)
    s = pd.Series(values[:split]).ewm(alpha=ALPHA, adjust=False).mean().iloc[-1]
    assert st["last_smooth"] == pytest.approx(s, rel=1e-12)
    test = np.array(values[split:])
    assert st["rmse"] == pytest.approx(math.sqrt(np.mean((test - s) ** 2)))
    growth = pd.Series(values).pct_change().dropna().mean() * 0.65
    assert st["growth"] == pytest.approx(growth)


def test_es_forecast_band_and_dates(spark):
    values = [100.0 + 3 * i for i in range(12)]
    feats = add_features(_series(spark, values), [])
    fc = G.es_forecast(es_fit(feats, []), [], horizon=12).orderBy("step").toPandas()
    assert (fc["lower"] <= fc["forecast"]).all() and (fc["forecast"] <= fc["upper"]).all()
    width = (fc["upper"] - fc["lower"]).to_numpy()
    assert (np.diff(width) >= -0.02).all()               # widens with the step
    assert str(fc["date"].iloc[0].date()) == "2022-01-01"


def test_end_of_month_clamp(spark):
    df = spark.createDataFrame([("2024-01-31",)], "d string").select(
        F.to_date("d").cast("timestamp_ntz").alias("last_date"))
    from panelcast.functions.dates import add_months
    got = df.select(add_months(F.col("last_date"), 1).alias("x")).first()[0]
    assert str(got.date()) == "2024-02-29"


def _scorer(expression):
    from pyspark.ml.feature import SQLTransformer
    return SQLTransformer(statement=f"SELECT *, {expression} AS prediction FROM __THIS__")


@pytest.mark.parametrize("expression, want", [
    ("_x_lag_1 + 10", [50.0, 60.0, 70.0, 80.0]),                 # each step feeds the next
    ("_x_lag_3", [20.0, 30.0, 40.0, 20.0]),                     # three steps back: forecasts come round
    ("_x_rolling_mean_3 * 2", [60.0, 260 / 3, 1120 / 9, 4880 / 27]),
    ("_x_units_sold", [1.005, 1.01, 1.015, 1.02]),              # units drift by half a percent a step
    ("_x_price * 100", [100.2, 100.4, 100.6, 100.8]),
    ("_x_lag_1 - 1000", [0.0, 0.0, 0.0, 0.0]),                  # never below zero
    ("_x_month", [5.0, 6.0, 7.0, 8.0]),
])
def test_recursive_steps_by_hand(spark, expression, want):
    feats = add_features(_series(spark, [10.0, 20.0, 30.0, 40.0]), [])
    cols = ["lag_1", "lag_3", "rolling_mean_3", "units_sold", "price", "month"]
    rmse = spark.createDataFrame([(0.0,)], "rmse double")
    got = recursive_forecast(feats, _scorer(expression), cols, rmse, [], horizon=4).orderBy("step").toPandas()
    assert got["forecast"].tolist() == pytest.approx(want, abs=0.006)


def test_null_series_and_long_horizon(spark):
    feats = add_features(_series(spark, [10.0, 20.0, 30.0]).withColumn("k", F.lit(None).cast("string")), ["k"])
    rmse = spark.createDataFrame([(None, 1.0)], "k string, rmse double")
    assert recursive_forecast(feats, _scorer("_x_lag_1"), ["lag_1"], rmse, ["k"], horizon=15).count() == 15
    fc = G.es_forecast(es_fit(feats, ["k"]), ["k"], horizon=20, grain="day").orderBy("step").toPandas()
    assert len(fc) == 20 and (fc["date"].diff().dropna() == pd.Timedelta(days=1)).all()
    with pytest.raises(ValueError):
        G.es_forecast(es_fit(feats, ["k"]), ["k"], horizon=0)


def test_forest_does_not_depend_on_the_input_partitions(spark, sf_small):
    from panelcast.operators.models import FOREST
    feats = add_features(fx.sales_by_brand(spark, sf_small), ["series_key"])
    out = []
    for parts in (1, 8):
        r = train_models(feats.repartition(parts), ["series_key"], models=[FOREST], cv=False, include_es=False, trees=5)
        out.append(r.predictions.orderBy("series_key", "date").toPandas())
    pd.testing.assert_frame_equal(out[0], out[1])


def test_one_target_for_one_series(spark):
    fc = spark.createDataFrame([(1, 100.0), (2, 200.0)], "step int, forecast double").withColumn("date", F.lit(None).cast("timestamp_ntz"))
    one = spark.createDataFrame([(150.0,)], "target double")
    assert [r.meets_target for r in T.target_per_period(fc, one).orderBy("step").collect()] == [False, True]
    each = spark.createDataFrame([(1, 90.0), (2, 300.0)], "step int, target double")
    assert [r.meets_target for r in T.target_per_period(fc, each).orderBy("step").collect()] == [True, False]


def test_target_verdict_monotone(spark):
    fc = spark.createDataFrame([("A", 1, 100.0, 80.0, 120.0, 90.0)],
                               "k string, step int, forecast double, lower double, upper double, "
                               "last_actual double")
    tg = spark.createDataFrame([("A", 1, t) for t in (50.0, 100.0, 110.0, 120.0, 121.0)],
                               "k string, step int, target double")
    got = T.check_targets(fc, tg, ["k"]).orderBy("target").toPandas()
    assert got["verdict"].tolist() == ["YES", "YES", "MAYBE", "MAYBE", "NO"]
    assert got["shortfall"].iloc[-1] == pytest.approx(1.0)
    assert got["required_growth"].iloc[0] == pytest.approx((50 - 90) / 90 * 100)


def test_scenario_identity_and_rounding(spark):
    fc = spark.createDataFrame([("A", 1, 100.5), ("A", 2, 101.5)], "k string, step int, forecast double") \
        .withColumn("date", F.lit(None).cast("timestamp_ntz"))
    grid = F.array(F.struct(F.lit(1).alias("scenario_id"), F.lit(0).alias("price_pct"),
                            F.lit(0).alias("units_pct"), F.lit(0).alias("mkt_pct")))
    d = K.simulate(fc, grid, ["k"]).orderBy("step").toPandas()
    assert d["scenario"].tolist() == [100, 102]           # half-even, like numpy
    imp = K.impact(K.simulate(fc, grid, ["k"]), ["k"]).first()
    assert imp["impact"] == pytest.approx(0.0)
    assert imp["note"] == K.NOTE_PLAIN % 0.0


def test_lever_grid_size(spark):
    n = spark.range(1).select(F.size(K.lever_grid(5, 5, 5)).alias("n")).first()["n"]
    assert n == 21 * 21 * 27


def test_expanding_cv_uses_past_folds_only(spark, sf_small):
    feats = add_features(fx.sales_by_brand(spark, sf_small), ["series_key"])
    r = train_models(feats, ["series_key"], models=[LINEAR], include_es=False, cv_mode="expanding")
    row = r.metrics.first()
    assert row["cv_splits"] == 4 and row["cv_rmse_mean"] > 0


@pytest.mark.parametrize("name", ["es_forecast_by_brand", "scenario_best", "target_check"])
def test_partition_invariance_of_decisions(spark, sf_small, name):
    import __spark_entry__ as E
    q = E.queries()[name]
    results = []
    for parts in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            df = q(spark, sf_small).toPandas()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        results.append(df.sort_values(list(df.columns)).reset_index(drop=True))
    pd.testing.assert_frame_equal(results[0], results[1])


def test_saved_scenarios_belong_to_their_series(spark):
    fc = spark.createDataFrame([("A", 1, 100.0), ("A", 2, 200.0), (None, 1, 10.0)], "k string, step int, forecast double") \
        .withColumn("date", F.lit(None).cast("timestamp_ntz"))
    saved = spark.createDataFrame([("A", 7, 10, 0, 0), ("A", 8, 0, 0, 40), (None, 9, 0, 100, 0)],
                                  "k string, scenario_id int, price_pct int, units_pct int, mkt_pct int")
    imp = K.impact(K.simulate_saved(fc, saved, ["k"]), ["k"]).orderBy("scenario_id").toPandas()
    assert imp["scenario_total"].tolist() == [330, 342, 20]          # ×1.1, ×1.14 and ×2
    assert imp["note"].iloc[1] == K.NOTE_MARKETING % (40, 14.0)
    assert K.simulate_saved(fc.where("k = 'A'"), saved).count() == 6


def test_grid_totals_equal_the_rows(spark):
    fc = spark.createDataFrame([("A", 1, 100.5), ("A", 2, 201.25), ("B", 1, 3.5)], "k string, step int, forecast double") \
        .withColumn("date", F.lit(None).cast("timestamp_ntz"))
    grid = K.lever_grid(25, 50, 65)
    cols = ["k", "scenario_id", "scenario_total", "note"]
    rows = K.impact(K.simulate(fc, grid, ["k"]), ["k"])
    assert sorted(map(tuple, K.impacts(fc, grid, ["k"]).select(cols).collect())) == sorted(map(tuple, rows.select(cols).collect()))
    best = K.best_scenario(rows, ["k"]).select(cols)
    assert sorted(map(tuple, K.best_of(fc, grid, ["k"]).select(cols).collect())) == sorted(map(tuple, best.collect()))


def test_best_setting_of_odd_forecasts(spark):
    """Zeros (all settings tie), tiny values, a negative step, a null step: as by trying all settings."""
    from panelcast.operators import scenarios as K
    rows = [(k, i + 1, v) for k, vs in {"zero": [0.0, 0.0], "tiny": [0.4, 0.3], "plain": [1234.5, 99.0], "minus": [-50.0, 20.0],
                                        "down": [-50.0, -3.0], "half": [2.5, 1e9]}.items() for i, v in enumerate(vs)]
    fc = spark.createDataFrame(rows, "k string, step int, forecast double")
    grid = K.lever_grid(10, 10, 26)
    got = {r["k"]: (r["scenario_id"], r["scenario_total"]) for r in K.best_of(fc, grid, ["k"]).collect()}
    all_of = K.impacts(fc, grid, ["k"]).collect()
    for k in got:
        mine = [r for r in all_of if r["k"] == k]
        most = max(r["scenario_total"] for r in mine)
        assert got[k] == (min(r["scenario_id"] for r in mine if r["scenario_total"] == most), most)
