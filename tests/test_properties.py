"""Property tests: bounds, monotonicity, identities."""

import math

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.operators import forecast as G
from panelcast.operators import scenarios as K
from panelcast.operators import targets as T
from panelcast.operators.clean import clean_sales

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

money = st.floats(min_value=0.0, max_value=1e7, allow_nan=False, allow_infinity=False)


@SETTINGS
@given(values=st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=4,
                       max_size=30))
def test_capped_revenue_within_fences(spark, values):
    pdf = pd.DataFrame({"Date": pd.date_range("2020-01-01", periods=len(values), freq="D")
                        .strftime("%Y-%m-%d"), "Revenue": values, "seq": range(len(values))})
    clean, _ = clean_sales(spark.createDataFrame(pdf, "Date string, Revenue double, seq long"))
    got = clean.toPandas()["revenue"]
    s = pd.Series(values)
    q1, q3 = s.quantile([0.25, 0.75])
    hi, lo = q3 + 3 * (q3 - q1), max(0.0, q1 - 3 * (q3 - q1))
    assert (got >= lo - 1e-6 * max(1, abs(lo))).all() and (got <= hi + 1e-6 * max(1, abs(hi))).all()


@SETTINGS
@given(f=money, rmse=st.floats(min_value=0, max_value=1e6), step=st.integers(1, 12))
def test_band_contains_forecast(spark, f, rmse, step):
    row = spark.range(1).select(F.lit(f).alias("f"), F.lit(rmse).alias("r"), F.lit(step).alias("s"))
    lo, hi = G.band(F.col("f"), F.col("r"), F.col("s"))
    r = row.select(lo.alias("lo"), hi.alias("hi")).first()
    assert 0 <= r["lo"] <= f <= r["hi"]
    assert math.isclose(r["hi"] - f, rmse * 1.28 * (1 + 0.08 * (step - 1)), rel_tol=1e-9, abs_tol=1e-6)


@SETTINGS
@given(f=money, spread=st.floats(min_value=0, max_value=1e6),
       targets=st.lists(st.floats(min_value=0, max_value=2e7), min_size=2, max_size=6))
def test_verdict_monotone_in_target(spark, f, spread, targets):
    fc = spark.createDataFrame([("A", 1, f, max(0.0, f - spread), f + spread, 1.0)],
                               "k string, step int, forecast double, lower double, upper double, "
                               "last_actual double")
    tg = spark.createDataFrame([("A", 1, float(t)) for t in targets], "k string, step int, target double")
    got = T.check_targets(fc, tg, ["k"]).orderBy("target").toPandas()
    order = {"YES": 0, "MAYBE": 1, "NO": 2}
    ranks = [order[v] for v in got["verdict"]]
    assert ranks == sorted(ranks)


@SETTINGS
@given(base=money)
def test_zero_levers_are_identity(spark, base):
    fc = spark.createDataFrame([("A", 1, base)], "k string, step int, forecast double") \
        .withColumn("date", F.lit(None).cast("timestamp_ntz"))
    grid = F.array(F.struct(F.lit(1).alias("scenario_id"), F.lit(0).alias("price_pct"),
                            F.lit(0).alias("units_pct"), F.lit(0).alias("mkt_pct")))
    r = K.simulate(fc, grid, ["k"]).first()
    assert abs(r["scenario"] - base) <= 0.5
