"""Catalog entries for splits, smoothing, forecast, targets and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import forecast as G
from panelcast.operators import scenarios as K
from panelcast.operators import targets as T
from panelcast.operators.features import add_features
from panelcast.operators.report import model_section
from panelcast.operators.smoothing import es_fit, es_metrics, es_predictions, leaderboard, pooled_metrics
from panelcast.operators.splits import with_splits
from panelcast.plans import sql_fixtures as S
from panelcast.plans.catalog import register
from panelcast.sources import fixtures as fx

KEYS = ["series_key"]
FEAT = S.features_sql(S.SALES_BY_BRAND, KEYS)
D = "AS DOUBLE)"

def splits_cte(feat: str) -> str:
    return f"""
f AS ({feat}),
s AS (SELECT *, CAST(count(*) OVER (PARTITION BY series_key) AS INTEGER) AS n_rows FROM f),
s2 AS (SELECT *, CAST(greatest(floor(n_rows * CAST(0.8 {D}), n_rows - 6) AS INTEGER) AS split_idx,
              CASE WHEN n_rows >= 20 THEN 5 ELSE 3 END AS k FROM s),
s3 AS (
  SELECT *, row_idx >= split_idx AS is_test, CAST(k AS INTEGER) AS n_folds,
    CAST(CASE WHEN n_rows < k THEN NULL
              WHEN row_idx < (n_rows % k) * (n_rows // k + 1) THEN floor(row_idx / (n_rows // k + 1))
              ELSE (n_rows % k) + floor((row_idx - (n_rows % k) * (n_rows // k + 1)) / (n_rows // k))
         END AS INTEGER) AS fold
  FROM s2)"""


def es_cte(feat: str) -> str:
    return splits_cte(feat) + f""",
es AS (
  SELECT *,
    sum(CASE WHEN NOT is_test THEN revenue * ((CASE WHEN row_idx = 0 THEN CAST(1.0 {D} ELSE CAST(0.3 {D} END)
        * pow(CAST(1.0 {D} - CAST(0.3 {D}, CAST(split_idx - 1 - row_idx {D})) END)
        OVER (PARTITION BY series_key) AS level,
    (revenue - lag(revenue) OVER w) / NULLIF(lag(revenue) OVER w, 0) AS pct,
    avg(CASE WHEN is_test THEN revenue END) OVER (PARTITION BY series_key) AS test_mean
  FROM s3 WINDOW w AS (PARTITION BY series_key ORDER BY date)),
es2 AS (SELECT *, CASE WHEN is_test THEN revenue - level END AS err FROM es),
state AS (
  SELECT series_key, max(n_rows) AS n_rows, max(split_idx) AS n_train, max(date) AS last_date,
         arg_max(revenue, date) AS last_actual, arg_max(units_sold, date) AS last_units_sold,
         arg_max(price, date) AS last_price, first(level) AS last_smooth,
         avg(pct) * CAST(0.65 {D} AS growth, sqrt(avg(err * err)) AS rmse, avg(abs(err)) AS mae,
         1 - sum(err * err) / NULLIF(sum(CASE WHEN is_test THEN pow(revenue - test_mean, 2) END), 0) AS r2
  FROM es2 GROUP BY series_key)"""


STATE_ROUND = {"last_actual": 4, "last_price": 6, "last_smooth": 4, "growth": 9, "rmse": 4, "mae": 4, "r2": 6}

def fc_cte(feat: str) -> str:
    return es_cte(feat) + f""",
fc0 AS (
  SELECT series_key, last_actual, rmse, step,
         CAST(last_date + to_months(step) AS TIMESTAMP) AS date,
         greatest(0.0, last_smooth * pow(1 + coalesce(growth, 0.0), CAST(step {D})) AS v,
         rmse * CAST(1.28 {D} * (1 + CAST(0.08 {D} * (step - 1)) AS half
  FROM state, (SELECT CAST(range AS INTEGER) AS step FROM range(1, 7)) AS h),
fc AS (
  SELECT series_key, step, date, round(v, 2) AS forecast, round(greatest(0.0, v - half), 2) AS lower,
         round(greatest(0.0, v + half), 2) AS upper, last_actual
  FROM fc0)"""


SPLITS_CTE = splits_cte(FEAT)
ES_CTE = es_cte(FEAT)
FC_CTE = fc_cte(FEAT)


def brand_features(spark, sf):
    return add_features(fx.sales_by_brand(spark, sf), KEYS)


def brand_state(spark, sf):
    return es_fit(brand_features(spark, sf), KEYS)


def brand_es_forecast(spark, sf, horizon=6):
    return G.es_forecast(brand_state(spark, sf), KEYS, horizon)


@register("splits_by_brand", f"""WITH {SPLITS_CTE}
SELECT series_key, date, row_idx, n_rows, split_idx, is_test, n_folds, fold FROM s3""")
def q_splits_by_brand(spark, sf):
    """M-02, M-03: hold-out flag and fold per row."""
    return with_splits(brand_features(spark, sf), KEYS).select(
        *KEYS, "date", "row_idx", "n_rows", "split_idx", "is_test", "n_folds", "fold")


@register("es_state_by_brand", f"WITH {ES_CTE} SELECT * FROM state", STATE_ROUND)
def q_es_state_by_brand(spark, sf):
    """M-10, M-11, M-12: smoothing level, damped growth, hold-out metrics per brand."""
    return brand_state(spark, sf)


DROP_FEAT = S.features_drop_sql(S.SALES_BY_BRAND, KEYS)


@register("splits_drop_by_brand", f"""WITH {splits_cte(DROP_FEAT)}
SELECT series_key, date, row_idx, n_rows, split_idx, is_test, n_folds, fold FROM s3""")
def q_splits_drop_by_brand(spark, sf):
    """M-02, M-03 over features without the first three rows."""
    feats = add_features(fx.sales_by_brand(spark, sf), KEYS, fill="drop")
    return with_splits(feats, KEYS).select(
        *KEYS, "date", "row_idx", "n_rows", "split_idx", "is_test", "n_folds", "fold")


@register("es_state_drop_by_brand", f"WITH {es_cte(DROP_FEAT)} SELECT * FROM state", STATE_ROUND)
def q_es_state_drop_by_brand(spark, sf):
    """M-10…M-12 over features without the first three rows."""
    return es_fit(add_features(fx.sales_by_brand(spark, sf), KEYS, fill="drop"), KEYS)


@register("es_leaderboard", f"""WITH {ES_CTE},
p AS (SELECT revenue AS actual, level AS predicted, avg(revenue) OVER () AS m FROM es2 WHERE is_test),
mm AS (SELECT 'Exp. Smoothing (TS)' AS name, sqrt(avg(pow(actual - predicted, 2))) AS rmse,
              avg(abs(actual - predicted)) AS mae,
              1 - sum(pow(actual - predicted, 2)) / NULLIF(sum(pow(actual - m, 2)), 0) AS r2,
              count(*) AS n_test FROM p)
SELECT name, rmse, mae, r2, rmse AS cv_rmse_mean, 0.0 AS cv_rmse_std, mae AS cv_mae_mean,
       0.0 AS cv_mae_std, r2 AS cv_r2_mean, 0.0 AS cv_r2_std, 0 AS cv_splits, true AS is_ts, n_test,
       1 AS rank, 1 AS rank_holdout, true AS is_best, true AS is_best_holdout
FROM mm""", {"rmse": 4, "mae": 4, "r2": 6, "cv_rmse_mean": 4, "cv_mae_mean": 4, "cv_r2_mean": 6})
def q_es_leaderboard(spark, sf):
    """M-14, M-15, M-16 with the smoother alone (SQL-checkable leaderboard)."""
    return leaderboard(es_metrics(brand_features(spark, sf), KEYS))


@register("linear_cv_by_brand", f"""WITH {SPLITS_CTE},
t AS (SELECT fold, revenue AS y, month_sin AS x FROM s3 WHERE fold IS NOT NULL),
g AS (SELECT f.fold, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx, avg(y) AS my, avg(x) AS mx
      FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold GROUP BY f.fold),
c AS (SELECT 'Linear Regression' AS model, fold, sxy / sxx AS b, my - sxy / sxx * mx AS a FROM g
      UNION ALL SELECT 'Ridge Regression', fold, sxy / (sxx + 1), my - sxy / (sxx + 1) * mx FROM g),
p AS (SELECT model, fold, y AS actual, a + b * x AS predicted, avg(y) OVER (PARTITION BY model, fold) AS m FROM c JOIN t USING (fold))
SELECT model, fold, sqrt(avg(pow(actual - predicted, 2))) AS rmse, avg(abs(actual - predicted)) AS mae,
       1 - sum(pow(actual - predicted, 2)) / NULLIF(sum(pow(actual - m, 2)), 0) AS r2, count(*) AS n_test FROM p GROUP BY model, fold""",
          {"rmse": 4, "mae": 4, "r2": 6})
def q_linear_cv_by_brand(spark, sf):
    """M-04, M-05, M-06: cross-validated linear and ridge models of one feature, from sums per fold."""
    from panelcast.operators.gram import fold_fits, fold_moments, fold_predictions
    from panelcast.operators.models import LINEAR, RIDGE, RIDGE_ALPHA
    from panelcast.operators.training import assemble
    data = assemble(brand_features(spark, sf), KEYS, ["month_sin"])
    moments = fold_moments(data, 1)
    fits = {LINEAR: fold_fits(moments, moments, 0.0), RIDGE: fold_fits(moments, moments, RIDGE_ALPHA)}
    return pooled_metrics(fold_predictions(data, fits), by=["model", "fold"])


BASELINES_SQL = f"""{ES_CTE},
tail AS (SELECT series_key, last(revenue ORDER BY date) AS last_value, avg(revenue) AS mean_value
         FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date DESC) AS back FROM es2 WHERE NOT is_test)
         WHERE back <= 3 GROUP BY series_key),
pr AS (
  SELECT 'Exp. Smoothing (TS)' AS model, revenue AS actual, level AS predicted FROM es2 WHERE is_test
  UNION ALL SELECT 'Last Value', revenue, last_value FROM es2 JOIN tail USING (series_key) WHERE is_test
  UNION ALL SELECT 'Moving Average (3)', revenue, mean_value FROM es2 JOIN tail USING (series_key) WHERE is_test
  UNION ALL SELECT 'Moving Average (copy)', revenue, mean_value FROM es2 JOIN tail USING (series_key) WHERE is_test),
mm AS (SELECT model AS name, sqrt(avg(pow(actual - predicted, 2))) AS rmse, avg(abs(actual - predicted)) AS mae,
              1 - sum(pow(actual - predicted, 2)) / NULLIF(var_pop(actual) * count(*), 0) AS r2, count(*) AS n_test
       FROM pr GROUP BY model),
lb AS (SELECT *, CASE name WHEN 'Last Value' THEN rmse / 2 ELSE rmse END AS cv_rmse_mean FROM mm),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY round(cv_rmse_mean, 6), name) AS INTEGER) AS rank,
                  CAST(row_number() OVER (ORDER BY round(rmse, 6), name) AS INTEGER) AS rank_holdout FROM lb)"""


def baseline_leaderboard(spark, sf):
    """Four predictors that SQL can express, two of them tied; the cross-validated
    error of one is set so that the two rankings differ."""
    from pyspark.sql import Window
    feats = brand_features(spark, sf)
    staged = with_splits(feats, KEYS)
    back = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("date")))
    tail = (staged.where(~F.col("is_test")).withColumn("back", back).where("back <= 3").groupBy(*KEYS)
            .agg(F.max_by("revenue", "date").alias("last_value"), F.avg("revenue").alias("mean_value")))
    hold = staged.where("is_test").join(tail, KEYS)
    names = [("Last Value", "last_value"), ("Moving Average (3)", "mean_value"), ("Moving Average (copy)", "mean_value")]
    preds = es_predictions(feats, KEYS).select("model", "actual", "predicted")
    for name, col in names:
        preds = preds.unionByName(hold.select(F.lit(name).alias("model"), F.col("revenue").alias("actual"), F.col(col).alias("predicted")))
    m = pooled_metrics(preds).withColumnRenamed("model", "name").withColumns({c: F.round(c, 6) for c in ("rmse", "mae", "r2")})
    return leaderboard(m.withColumn("cv_rmse_mean", F.when(F.col("name") == "Last Value", F.col("rmse") / 2).otherwise(F.col("rmse"))))


@register("baseline_leaderboard", f"""WITH {BASELINES_SQL}
SELECT *, rank = 1 AS is_best, rank_holdout = 1 AS is_best_holdout FROM ranked""",
          {"rmse": 4, "mae": 4, "r2": 6, "cv_rmse_mean": 4})
def q_baseline_leaderboard(spark, sf):
    """M-12, M-15, M-16: both rankings, a tie broken by name, both best flags."""
    return baseline_leaderboard(spark, sf)


@register("report_baseline_models", f"""WITH {BASELINES_SQL}
SELECT name AS model, replace(format('{{:,.2f}}', round(rmse, 6)), ',', '') AS rmse, replace(format('{{:,.2f}}', round(mae, 6)), ',', '') AS mae,
       replace(format('{{:,.4f}}', round(r2, 6)), ',', '') AS r2, '$' || format('{{:,.0f}}', cv_rmse_mean) AS cv_rmse,
       rank_holdout = 1 AS best_holdout FROM ranked""")
def q_report_baseline_models(spark, sf):
    """H-03 over that leaderboard."""
    return model_section(baseline_leaderboard(spark, sf))


@register("es_forecast_by_brand", f"WITH {FC_CTE} SELECT * FROM fc", {"last_actual": 4})
def q_es_forecast_by_brand(spark, sf):
    """G-02…G-09: 6-month smoothing forecast with band per brand."""
    return brand_es_forecast(spark, sf)


@register("forecast_kpis", f"""WITH {FC_CTE}
SELECT series_key, sum(forecast) AS total_forecast, arg_min(forecast, step) AS next_forecast,
       arg_max(forecast, step) AS final_forecast, first(last_actual) AS last_actual,
       (arg_max(forecast, step) - first(last_actual)) / NULLIF(first(last_actual), 0) * 100 AS period_growth
FROM fc GROUP BY series_key""", {"total_forecast": 2, "last_actual": 4, "period_growth": 6})
def q_forecast_kpis(spark, sf):
    """G-10: total, next, final and period growth per brand."""
    return G.forecast_kpis(brand_es_forecast(spark, sf), KEYS)


@register("forecast_overlay", f"""WITH {FC_CTE}
SELECT series_key, 'history' AS kind, date, revenue AS value, 0 AS ord FROM f
UNION ALL SELECT series_key, 'forecast', date, forecast, step FROM fc
UNION ALL SELECT series_key, 'band', date, upper, step FROM fc
UNION ALL SELECT series_key, 'band', date, lower,
          CAST(2 * max(step) OVER (PARTITION BY series_key) + 1 - step AS INTEGER) FROM fc""", {"value": 4})
def q_forecast_overlay(spark, sf):
    """G-11: history + forecast + closed band outline."""
    return G.overlay(brand_features(spark, sf), brand_es_forecast(spark, sf), KEYS)


@register("forecast_table", f"""WITH {FC_CTE}
SELECT series_key, step, strftime(date, '%b %Y') AS month,
       '$' || format('{{:,.0f}}', forecast) AS forecast, '$' || format('{{:,.0f}}', lower) AS lower,
       '$' || format('{{:,.0f}}', upper) AS upper FROM fc""")
def q_forecast_table(spark, sf):
    """G-12: formatted forecast table."""
    return G.forecast_table(brand_es_forecast(spark, sf), KEYS)


def target_cte(feat: str) -> str:
    return fc_cte(feat) + f""",
tg AS (SELECT series_key, max(step) AS step, avg(forecast) * CAST(1.1 {D} AS target
       FROM fc GROUP BY series_key),
j AS (SELECT tg.target, fc.* FROM tg JOIN fc USING (series_key, step)),
v AS (SELECT *, CASE WHEN target <= forecast THEN 'YES' WHEN target <= upper THEN 'MAYBE'
                     ELSE 'NO' END AS verdict FROM j)"""


TARGET_CTE = target_cte(FEAT)


TARGET_SELECT = f"""
SELECT series_key, step, 'Month ' || CAST(step AS VARCHAR) AS period, target, forecast, lower, upper,
  verdict,
  CASE verdict WHEN 'YES' THEN '{T.VERDICT_YES}' WHEN 'MAYBE' THEN '{T.VERDICT_MAYBE}'
       ELSE '{T.VERDICT_NO}' END AS label,
  CASE WHEN verdict = 'YES' THEN (forecast - target) / NULLIF(target, 0) * 100 END AS margin_pct,
  CASE WHEN verdict = 'NO' THEN target - upper END AS shortfall,
  CASE verdict
    WHEN 'YES' THEN printf('{T.NOTE_YES}', '$' || format('{{:,.0f}}', forecast),
                           (forecast - target) / NULLIF(target, 0) * 100)
    WHEN 'MAYBE' THEN printf('{T.NOTE_MAYBE}', '$' || format('{{:,.0f}}', upper))
    ELSE printf('{T.NOTE_NO}', '$' || format('{{:,.0f}}', target - upper)) END AS note,
  CASE verdict WHEN 'YES' THEN '{T.REC_YES}' WHEN 'MAYBE' THEN '{T.REC_MAYBE}'
       ELSE '{T.REC_NO}' END AS recommendation,
  (target - last_actual) / NULLIF(last_actual, 0) * 100 AS required_growth
FROM v"""
TARGET_ROUND = {"target": 4, "margin_pct": 6, "shortfall": 4, "required_growth": 6}


@register("target_check", f"WITH {TARGET_CTE} {TARGET_SELECT}", TARGET_ROUND)
def q_target_check(spark, sf):
    """T-01…T-05: default target (1.1 × mean forecast) at the last step."""
    return T.check_default_targets(brand_es_forecast(spark, sf), KEYS)


@register("target_per_period", f"""WITH {TARGET_CTE}
SELECT fc.series_key, fc.step, fc.date, fc.forecast, tg.target, fc.forecast >= tg.target AS meets_target
FROM fc JOIN tg USING (series_key)""", {"target": 4})
def q_target_per_period(spark, sf):
    """T-06: each step against the target."""
    return T.target_per_period(brand_es_forecast(spark, sf), None, KEYS)


# Price, volume and marketing steps: the sliders' own for the best setting,
# coarser ones where every setting is a result row.
FINE = (1, 1, 5)
GRID = (5, 5, 10)


def scen_cte(feat: str, steps: tuple = GRID) -> str:
    return fc_cte(feat) + f""",
grid AS (
  SELECT CAST(row_number() OVER (ORDER BY p, u, m) AS INTEGER) AS scenario_id,
         CAST(p AS INTEGER) AS price_pct, CAST(u AS INTEGER) AS units_pct, CAST(m AS INTEGER) AS mkt_pct
  FROM range(-50, 51, {steps[0]}) t1(p), range(-50, 51, {steps[1]}) t2(u),
       range(-30, 101, {steps[2]}) t3(m)),
det AS (
  SELECT fc.series_key, g.scenario_id, g.price_pct, g.units_pct, g.mkt_pct, fc.step, fc.forecast AS base,
         CAST(round_even(fc.forecast * ((1 + g.price_pct / CAST(100.0 {D}) * (1 + g.units_pct / CAST(100.0 {D})
              * (1 + g.mkt_pct / CAST(100.0 {D} * CAST(0.35 {D})), 0) AS BIGINT) AS scenario
  FROM fc, grid g),
imp AS (
  SELECT series_key, scenario_id, price_pct, units_pct, mkt_pct, sum(base) AS base_total,
         CAST(sum(scenario) AS BIGINT) AS scenario_total, sum(CAST(scenario AS DOUBLE) - base) AS impact
  FROM det GROUP BY ALL),
imp2 AS (
  SELECT *, impact / NULLIF(base_total, 0) * 100 AS impact_pct FROM imp)"""


SCEN_CTE = scen_cte(FEAT)

IMPACT_ROUND = {"base_total": 2, "impact": 2, "impact_pct": 6}
NOTE_SQL = f"""
  CASE WHEN abs(price_pct) > 5 AND abs(units_pct) > 5
         THEN printf('{K.NOTE_BOTH}', price_pct, units_pct, impact_pct)
       WHEN mkt_pct > 20 THEN printf('{K.NOTE_MARKETING}', mkt_pct, impact_pct)
       WHEN abs(price_pct) > 5 THEN printf('{K.NOTE_PRICE}', price_pct, impact_pct)
       ELSE printf('{K.NOTE_PLAIN}', impact_pct) END AS note,
  CASE WHEN impact >= 0 THEN 'success' ELSE 'danger' END AS note_type"""


def brand_impacts(spark, sf, steps=GRID):
    return K.impacts(brand_es_forecast(spark, sf), K.lever_grid(*steps), KEYS)


@register("scenario_impacts", f"WITH {SCEN_CTE} SELECT *, {NOTE_SQL} FROM imp2", IMPACT_ROUND)
def q_scenario_impacts(spark, sf):
    """K-01…K-05: every lever setting on a grid of 5, 5 and 10 points, per brand."""
    return brand_impacts(spark, sf)


BEST_SELECT = f""",
r AS (SELECT *, {NOTE_SQL},
             row_number() OVER (PARTITION BY series_key ORDER BY impact DESC, scenario_id) AS rk
      FROM imp2)
SELECT * EXCLUDE (rk) FROM r WHERE rk = 1"""


@register("scenario_best", f"WITH {scen_cte(FEAT, FINE)}{BEST_SELECT}", IMPACT_ROUND)
def q_scenario_best(spark, sf):
    """K-07: best lever setting per brand."""
    return K.best_of(brand_es_forecast(spark, sf), K.lever_grid(*FINE), KEYS)


@register("scenario_detail", f"""WITH {SCEN_CTE}
SELECT series_key, scenario_id, price_pct, units_pct, mkt_pct, step, base, scenario,
       CAST(scenario AS DOUBLE) - base AS diff, scenario >= base AS better
FROM det WHERE scenario_id IN (SELECT scenario_id FROM grid WHERE price_pct = 10 AND units_pct = -10
                               AND mkt_pct = 20)""", {"diff": 2})
def q_scenario_detail(spark, sf):
    """K-02, K-04: per-step scenario revenue for one saved lever setting."""
    grid = F.filter(K.lever_grid(*GRID), lambda g: (g["price_pct"] == 10) & (g["units_pct"] == -10) & (g["mkt_pct"] == 20))
    return K.simulate(brand_es_forecast(spark, sf), grid, KEYS).drop("date")


SAVED_SQL = """
saved AS (SELECT series_key, CAST(i AS INTEGER) AS scenario_id, CAST(i * 5 - 10 AS INTEGER) AS price_pct,
                 CAST(10 - i * i AS INTEGER) AS units_pct, CAST(i * 10 AS INTEGER) AS mkt_pct
          FROM (SELECT DISTINCT series_key FROM fc), range(1, 4) r(i))"""


def saved_scenarios(spark, sf):
    """Three settings per brand, as users save them: rows of a table."""
    from panelcast.sources.tables import table
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("series_key")).distinct()
    i = F.col("scenario_id")
    return (brands.select("series_key", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("scenario_id"))
            .select("series_key", "scenario_id", (i * 5 - 10).alias("price_pct"), (10 - i * i).alias("units_pct"),
                    (i * 10).alias("mkt_pct")))


@register("scenario_saved_by_brand", f"""WITH {FC_CTE}, {SAVED_SQL},
det AS (
  SELECT fc.series_key, g.scenario_id, g.price_pct, g.units_pct, g.mkt_pct, fc.forecast AS base,
         CAST(round_even(fc.forecast * ((1 + g.price_pct / CAST(100.0 {D}) * (1 + g.units_pct / CAST(100.0 {D})
              * (1 + g.mkt_pct / CAST(100.0 {D} * CAST(0.35 {D})), 0) AS BIGINT) AS scenario
  FROM fc JOIN saved g USING (series_key)),
imp2 AS (
  SELECT *, impact / NULLIF(base_total, 0) * 100 AS impact_pct FROM (
    SELECT series_key, scenario_id, price_pct, units_pct, mkt_pct, sum(base) AS base_total,
           CAST(sum(scenario) AS BIGINT) AS scenario_total, sum(CAST(scenario AS DOUBLE) - base) AS impact
    FROM det GROUP BY ALL))
SELECT *, {NOTE_SQL} FROM imp2""", IMPACT_ROUND)
def q_scenario_saved_by_brand(spark, sf):
    """K-06 → K-01…K-05: saved settings, a table keyed by series, joined to the forecast."""
    fc = brand_es_forecast(spark, sf)
    return K.impact(K.simulate_saved(fc, saved_scenarios(spark, sf), KEYS), KEYS)


NUMBERS_SQL = """
SELECT DISTINCT unnest([l_quantity / 8, -l_quantity / 8, l_quantity + 0.675::DOUBLE, l_quantity * 1.125::DOUBLE, 0.005::DOUBLE * l_quantity,
                        l_extendedprice / 1000]) AS x FROM lineitem"""


@register("number_texts", f"""SELECT x, printf('%.1f', x) AS one, printf('%+.1f', x) AS signed, printf('%.2f', x) AS two,
  printf('%.3f', x) AS three, '$' || format('{{:,.0f}}', x) AS dollars, format('{{:,.2f}}', x) AS cents FROM ({NUMBERS_SQL})""")
def q_number_texts(spark, sf):
    """K-05, E-10, T-05, J-03…J-07: exact texts, ties among them (56.25, 0.125, 2.675)."""
    from panelcast.functions.numbers import filled, fixed, money
    from panelcast.sources.tables import table
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    x = table(spark, sf, "lineitem").select(F.explode(F.array(
        q / 8, -q / 8, q + 0.675, q * 1.125, 0.005 * q, p / 1000)).alias("x")).distinct()
    return x.select("x", filled("%.1f", F.col("x")).alias("one"), filled("%+.1f", F.col("x")).alias("signed"),
                    fixed(F.col("x"), 2).alias("two"), fixed(F.col("x"), 3).alias("three"), money(F.col("x")).alias("dollars"),
                    filled("%,.2f", F.col("x")).alias("cents"))


TIED_SQL = """
tied AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 10 AS DOUBLE) AS base_total, l_quantity / 8 AS impact,
                CAST(l_linenumber * 5 - 10 AS INTEGER) AS price_pct, CAST(10 - l_linenumber AS INTEGER) AS units_pct,
                CAST(l_quantity AS INTEGER) AS mkt_pct FROM lineitem),
imp2 AS (SELECT *, impact / NULLIF(base_total, 0) * 100 AS impact_pct FROM tied)"""


@register("scenario_notes_tied", f"WITH {TIED_SQL} SELECT *, {NOTE_SQL} FROM imp2", {"impact_pct": 6})
def q_scenario_notes_tied(spark, sf):
    """K-05: impact notes over rows whose percentages often end in exactly half a tenth."""
    from panelcast.sources.tables import table
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    return K.noted(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (n * 10).cast("double").alias("base_total"), (q / 8).alias("impact"), (n * 5 - 10).cast("int").alias("price_pct"),
        (10 - n).cast("int").alias("units_pct"), q.cast("int").alias("mkt_pct")))


# ── the same operators on the other panels ──────────────────────────────────

OTHER_PANELS = {
    "by_priority": (S.ORDERS_BY_PRIORITY, fx.orders_by_priority),
    "by_nation": (S.SALES_BY_NATION, fx.sales_by_nation),
    "event_daily": (S.EVENT_VALUE_DAILY, fx.event_value_daily),
}


def _register_panel(suffix: str, panel_sql: str, build) -> None:
    feat = S.features_sql(panel_sql, KEYS)

    def forecast(spark, sf):
        return G.es_forecast(es_fit(add_features(build(spark, sf), KEYS), KEYS), KEYS)

    register(f"es_state_{suffix}", f"WITH {es_cte(feat)} SELECT * FROM state", STATE_ROUND)(
        lambda spark, sf: es_fit(add_features(build(spark, sf), KEYS), KEYS))
    register(f"es_forecast_{suffix}", f"WITH {fc_cte(feat)} SELECT * FROM fc", {"last_actual": 4})(forecast)
    register(f"target_check_{suffix}", f"WITH {target_cte(feat)} {TARGET_SELECT}", TARGET_ROUND)(
        lambda spark, sf: T.check_default_targets(forecast(spark, sf), KEYS))
    register(f"scenario_best_{suffix}", f"WITH {scen_cte(feat, FINE)}{BEST_SELECT}", IMPACT_ROUND)(
        lambda spark, sf: K.best_of(forecast(spark, sf), K.lever_grid(*FINE), KEYS))


for _suffix, (_sql, _build) in OTHER_PANELS.items():
    _register_panel(_suffix, _sql, _build)
