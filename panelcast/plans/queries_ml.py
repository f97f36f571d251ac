"""Catalog entries for model-dependent steps (rows-only checks) and report
sections (SQL-checked where the inputs are the smoothing path).

Training all models is the expensive step; it is memoised per (Spark
application, data folder). Its metrics and hold-out predictions are checkpointed, so
the memo holds no long lineage.
"""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from panelcast.functions.numbers import fixed
from panelcast.operators import attribution as A
from panelcast.operators import importance as I
from panelcast.operators import insights as J
from panelcast.operators import report as H
from panelcast.operators import targets as T
from panelcast.operators.insights import insights
from panelcast.operators.recursive import recursive_forecast
from panelcast.operators.smoothing import es_fit, es_metrics, leaderboard
from panelcast.operators.training import assemble, train_models
from panelcast.plans import analysis
from panelcast.plans import sql_fixtures as S
from panelcast.plans.catalog import ORACLE, register
from panelcast.plans.queries_model import (ES_CTE, FC_CTE, KEYS, TARGET_CTE, brand_es_forecast,
                                           brand_features)
from panelcast.sources import fixtures as fx
from panelcast.sources import sinks as SK

_TRAINED: dict = {}


def trained(spark, sf):
    # Keyed by the application, so a later session never sees another's frames.
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        _TRAINED[key] = train_models(brand_features(spark, sf), KEYS)
    return _TRAINED[key]


@register("model_leaderboard")
def q_model_leaderboard(spark, sf):
    """M-01, M-04…M-09, M-12, M-14…M-16: all six models, 5-fold CV, ranked."""
    return trained(spark, sf).metrics


@register("model_predictions")
def q_model_predictions(spark, sf):
    """M-13: hold-out actual vs predicted for every model and brand."""
    return trained(spark, sf).predictions


@register("ml_forecast_by_brand")
def q_ml_forecast_by_brand(spark, sf):
    """G-01: 6-month forecast per brand with the best model (recursive if ML)."""
    return analysis.best_forecast(brand_features(spark, sf), trained(spark, sf), KEYS)


@register("ml_forecast_forest_by_brand")
def q_ml_forecast_forest_by_brand(spark, sf):
    """G-01 with the forest: lags fed back step by step for all brands at once."""
    return analysis.best_forecast(brand_features(spark, sf), trained(spark, sf), KEYS,
                                  model="Random Forest")


@register("importance_by_brand")
def q_importance_by_brand(spark, sf):
    """I-06 → I-08, I-09: permutation importance of the best model, top 10."""
    return analysis.best_importance(brand_features(spark, sf), trained(spark, sf), KEYS, fallback=False)


@register("importance_linear_by_brand")
def q_importance_linear_by_brand(spark, sf):
    """I-04 → I-08: linear attribution of the OLS model."""
    return analysis.best_importance(brand_features(spark, sf), trained(spark, sf), KEYS,
                                    model="Linear Regression", method="linear", fallback=False)


@register("importance_shapley_by_brand")
def q_importance_shapley_by_brand(spark, sf):
    """I-03 → I-08: Shapley-sampling importance of the forest over all training rows."""
    return analysis.best_importance(brand_features(spark, sf), trained(spark, sf), KEYS,
                                    model="Random Forest", method="shapley", fallback=False)


@register("importance_tree_by_brand")
def q_importance_tree_by_brand(spark, sf):
    """I-03 → I-08: path-dependent tree values of the forest over all training rows."""
    return analysis.best_importance(brand_features(spark, sf), trained(spark, sf), KEYS, model="Random Forest", method="model", fallback=False)


@register("importance_dependent_linear_by_brand")
def q_importance_dependent_linear_by_brand(spark, sf):
    """I-04 → I-08: values of the OLS model with features that depend on each other."""
    return analysis.best_importance(brand_features(spark, sf), trained(spark, sf), KEYS, model="Linear Regression", method="model", fallback=False)


@register("importance_kernel_by_brand")
def q_importance_kernel_by_brand(spark, sf):
    """I-05 → I-08: kernel values of the RBF pipeline over all training rows."""
    return analysis.best_importance(brand_features(spark, sf), trained(spark, sf), KEYS, model="RBF Ridge (RFF)", method="model", fallback=False)


@register("insights_by_brand")
def q_insights_by_brand(spark, sf):
    """J-01…J-07 for the best model."""
    t = trained(spark, sf)
    feats = brand_features(spark, sf)
    imp = analysis.best_importance(feats, t, KEYS, fallback=False)
    return insights(imp, t.metrics.filter("is_best"), feats)


# ── the same operators where SQL can follow them ────────────────────────────

# A stand-in for a fitted model: documented coefficients per feature.
FIXED_COEFFICIENTS = {"lag_1": 0.4, "rolling_mean_3": 0.3, "lag_2": 0.1, "month_sin": 5000.0, "month_cos": -3000.0,
                      "units_sold": 25.0, "price": -2.0, "quarter": 100.0}
FIXED_INTERCEPT = 1000.0
FEAT = S.features_sql(S.SALES_BY_BRAND, KEYS)
_TRAIN_SQL = f"""{ES_CTE},
tr AS (SELECT * FROM es2 WHERE NOT is_test),
mu AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in FIXED_COEFFICIENTS)} FROM tr),
att AS ({' UNION ALL '.join(
    f"SELECT series_key, date, '{c}' AS feature, CAST({b} AS DOUBLE) * ({c} - m_{c}) AS shap FROM tr, mu"
    for c, b in FIXED_COEFFICIENTS.items())}),
raw AS (SELECT feature, avg(abs(shap)) AS importance FROM att GROUP BY feature),
pct AS (SELECT feature, round_even(importance / sum(importance) OVER () * 100, 2) AS importance FROM raw),
nrm AS (SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature, importance
        FROM pct WHERE importance > 0)"""


def _friendly_sql(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.FRIENDLY_NAMES.items()) + f" ELSE {column} END"


def _train_rows(spark, sf):
    return assemble(brand_features(spark, sf), KEYS, list(FIXED_COEFFICIENTS)).where(~F.col("is_test"))


@register("row_attributions_by_brand", f"WITH {_TRAIN_SQL} SELECT series_key, date, feature, shap FROM att", {"shap": 3})
def q_row_attributions_by_brand(spark, sf):
    """I-10: the attribution of every training row, for fixed linear coefficients."""
    return I.linear_rows(list(FIXED_COEFFICIENTS.values()), _train_rows(spark, sf), list(FIXED_COEFFICIENTS), [*KEYS, "date"])


@register("importance_fixed_by_brand", f"""WITH {_TRAIN_SQL}
SELECT {_friendly_sql('feature')} AS feature, importance, '{I.METHOD_LINEAR}' AS method, rank FROM nrm WHERE rank <= 10""")
def q_importance_fixed_by_brand(spark, sf):
    """I-04 → I-08, I-09 with fixed linear coefficients."""
    return I.normalise(I.linear_attribution(list(FIXED_COEFFICIENTS.values()), _train_rows(spark, sf), list(FIXED_COEFFICIENTS)))


# Two trees and two coefficients as stand-ins for fitted ones. A node is (id, cover, value, left, right, feature, threshold).
FIXED_TREE_FEATURES = ["lag_1", "month", "units_sold"]
FIXED_TREES = [[(0, 100.0, 0.0, 1, 2, 0, 150000.0), (1, 60.0, 0.0, 3, 4, 1, 6.0), (2, 40.0, 0.0, 5, 6, 2, 300.0), (3, 36.0, 90000.0, -1, -1, -1, 0.0),
                (4, 24.0, 130000.0, -1, -1, -1, 0.0), (5, 10.0, 170000.0, -1, -1, -1, 0.0), (6, 30.0, 260000.0, -1, -1, -1, 0.0)],
               [(0, 80.0, 0.0, 1, 2, 2, 250.0), (1, 20.0, -4000.0, -1, -1, -1, 0.0), (2, 60.0, 7000.0, -1, -1, -1, 0.0)]]


def _tree_sql() -> str:
    """Every leaf's values by the definition: of one feature v (o - z), of two v (o - z) (z' + o') / 2."""
    leaves = []
    for tree in FIXED_TREES:
        nodes = {n[0]: n for n in tree}

        def walk(i, path, nodes=nodes, leaves=leaves):
            _, cover, value, left, right, f, t = nodes[i]
            if left < 0:
                for j, (name, test, z) in enumerate(path):
                    own = f"{value}::DOUBLE * (({test})::INT - {z}::DOUBLE)"
                    other = "".join(f" * ({z2}::DOUBLE + ({test2})::INT) / 2" for k, (_, test2, z2) in enumerate(path) if k != j)
                    leaves.append(f"SELECT series_key, date, '{name}' AS feature, {own}{other} AS shap FROM tr")
                return
            name = FIXED_TREE_FEATURES[f]
            walk(left, [*path, (name, f"{name} <= {t}", nodes[left][1] / cover)])
            walk(right, [*path, (name, f"{name} > {t}", nodes[right][1] / cover)])
        walk(0, [])
    return " UNION ALL ".join(leaves)


@register("row_attributions_fixed_trees", f"""WITH {ES_CTE}, tr AS (SELECT * FROM es2 WHERE NOT is_test)
SELECT series_key, date, feature, sum(shap) AS shap FROM ({_tree_sql()}) GROUP BY ALL""", {"shap": 4})
def q_row_attributions_fixed_trees(spark, sf):
    """I-03, I-10: tree values of every training row, for two fixed trees."""
    nodes = spark.createDataFrame([(t, *n) for t, tree in enumerate(FIXED_TREES) for n in tree],
                                  "tree int, id int, cover double, value double, left int, right int, feature int, threshold double")
    rows = assemble(brand_features(spark, sf), KEYS, FIXED_TREE_FEATURES).where(~F.col("is_test"))
    return A.tree_rows(nodes, rows, FIXED_TREE_FEATURES, [*KEYS, "date"])


DEPENDENT = {"lag_1": 0.4, "units_sold": 25.0}


@register("row_attributions_dependent", f"""WITH {ES_CTE}, tr AS (SELECT * FROM es2 WHERE NOT is_test),
m AS (SELECT avg(lag_1) AS ma, avg(units_sold) AS mb, covar_pop(lag_1, units_sold) AS c, var_pop(lag_1) AS va, var_pop(units_sold) AS vb FROM tr),
g AS (SELECT series_key, date, lag_1 - ma AS a, units_sold - mb AS b, 0.4::DOUBLE + 25.0::DOUBLE * c / va AS ka, 25.0::DOUBLE + 0.4::DOUBLE * c / vb AS kb FROM tr, m)
SELECT series_key, date, 'lag_1' AS feature, (ka * a + (0.4::DOUBLE * a + 25.0::DOUBLE * b - kb * b)) / 2 AS shap FROM g
UNION ALL SELECT series_key, date, 'units_sold', (kb * b + (0.4::DOUBLE * a + 25.0::DOUBLE * b - ka * a)) / 2 FROM g""", {"shap": 3})
def q_row_attributions_dependent(spark, sf):
    """I-04, I-10: values of two dependent features under fixed coefficients."""
    rows = assemble(brand_features(spark, sf), KEYS, list(DEPENDENT)).where(~F.col("is_test"))
    return A.dependent_linear_rows(list(DEPENDENT.values()), rows, list(DEPENDENT), [*KEYS, "date"])


@register("top_drivers_by_brand", f"""WITH {_TRAIN_SQL}
SELECT {_friendly_sql('feature')} AS feature, importance, '{I.METHOD_LINEAR}' AS method, rank FROM nrm WHERE rank <= 3""")
def q_top_drivers_by_brand(spark, sf):
    """I-11: the three first drivers of that table."""
    return I.top_drivers(q_importance_fixed_by_brand(spark, sf), 3)


_ES_WEIGHTS = ", ".join(f"({i}, '{I.FRIENDLY_NAMES[f]}', {w})" for i, (f, w) in enumerate(I.TS_HEURISTIC, 1))


@register("insights_es_by_brand", f"""WITH {ES_CTE},
imp(rank, feature, importance) AS (VALUES {_ES_WEIGHTS}),
p AS (SELECT revenue AS actual, level AS predicted, avg(revenue) OVER () AS m FROM es2 WHERE is_test),
met AS (SELECT sqrt(avg(pow(actual - predicted, 2))) AS rmse,
               1 - sum(pow(actual - predicted, 2)) / sum(pow(actual - m, 2)) AS r2 FROM p),
e AS (SELECT rmse, r2, rmse / (SELECT avg(revenue) FROM f) * 100 AS err FROM met),
season AS (SELECT sum(importance) AS v FROM imp WHERE regexp_matches(lower(feature), '{J.SEASON_WORDS}')),
momentum AS (SELECT sum(importance) AS v FROM imp WHERE regexp_matches(lower(feature), '{J.MOMENTUM_WORDS}')),
price AS (SELECT arg_min(importance, rank) AS v FROM imp WHERE contains(lower(feature), 'price'))
SELECT 2 AS seq, 'info' AS type, printf('{J.T_METHOD.replace("'", "''")}', '{I.METHOD_HEURISTIC}') AS text
UNION ALL SELECT 3, 'info', printf('{J.T_FIRST}', a.feature, a.importance::DOUBLE) FROM imp a WHERE rank = 1
UNION ALL SELECT 4, 'info', printf('{J.T_SECOND}', b.feature, b.importance::DOUBLE, (a.importance + b.importance)::DOUBLE)
  FROM imp a, imp b WHERE a.rank = 1 AND b.rank = 2
UNION ALL SELECT 5, 'warning', printf('{J.T_SEASON}', v::DOUBLE) FROM season WHERE v IS NOT NULL
UNION ALL SELECT 6, 'success', printf('{J.T_MOMENTUM}', v::DOUBLE) FROM momentum
UNION ALL SELECT 7, CASE WHEN v > {J.PRICE_DANGER} THEN 'danger' ELSE 'info' END,
  printf('{J.T_PRICE}', v::DOUBLE, CASE WHEN v > {J.PRICE_HIGH} THEN '{J.T_PRICE_HIGH}' ELSE '{J.T_PRICE_LOW}' END) FROM price
UNION ALL SELECT 8, CASE WHEN r2 > {J.R2_GOOD} THEN 'success' ELSE 'warning' END,
  printf('{J.T_QUALITY}', CASE WHEN r2 > {J.R2_EXCELLENT} THEN 'excellent' WHEN r2 > {J.R2_GOOD} THEN 'good' ELSE 'moderate' END,
         r2, err, CASE WHEN rmse > 0 THEN printf('{J.T_CV}', '$' || format('{{:,.0f}}', rmse), '$0') ELSE '' END,
         CASE WHEN err < {J.ERROR_CONFIDENT} THEN '{J.T_SURE}' ELSE '{J.T_UNSURE}' END) FROM e""")
def q_insights_es_by_brand(spark, sf):
    """I-01, I-09, J-02…J-07: the smoother's heuristic importance and metrics as texts."""
    feats = brand_features(spark, sf)
    raw = I.heuristic_importance(spark, [f for f, _ in I.TS_HEURISTIC])
    return insights(I.normalise(raw), leaderboard(es_metrics(feats, KEYS)).filter("is_best"), feats)


@register("insights_without_importance", f"SELECT 1 AS seq, 'warning' AS type, '{J.T_NONE}' AS text")
def q_insights_without_importance(spark, sf):
    """J-01: nothing to report on."""
    feats = brand_features(spark, sf)
    none = I.normalise(I.heuristic_importance(spark, ["lag_1"]).where("importance < 0"))
    return insights(none, leaderboard(es_metrics(feats, KEYS)).filter("is_best"), feats)


_STEP_INPUTS = {"lag_1": "h[-1]", "rolling_mean_3": "list_avg(h[-3:])", "lag_2": "coalesce(h[-2], h[-1])",
                "month_sin": "sin(2 * pi() * month(d) / 12)", "month_cos": "cos(2 * pi() * month(d) / 12)",
                "units_sold": "u * (1 + 0.005::DOUBLE * i)", "price": "pr * (1 + 0.002::DOUBLE * i)", "quarter": "quarter(d)"}
_PREDICTION = " + ".join(f"{b}::DOUBLE * {_STEP_INPUTS[c]}" for c, b in FIXED_COEFFICIENTS.items())


@register("recursive_forecast_fixed_by_brand", f"""WITH RECURSIVE {ES_CTE},
st AS (SELECT series_key, last_date, last_actual, rmse, last_units_sold AS u, last_price AS pr, h FROM state
       JOIN (SELECT series_key, list(revenue ORDER BY date) AS h FROM f GROUP BY series_key) USING (series_key)),
rec AS (
  SELECT *, 0 AS i, CAST(NULL AS DOUBLE) AS v FROM st
  UNION ALL
  SELECT * EXCLUDE (x, d) REPLACE (list_append(h, x) AS h, i AS i, x AS v) FROM (
    SELECT *, greatest(0.0, {FIXED_INTERCEPT}::DOUBLE + {_PREDICTION}) AS x FROM (
      SELECT * REPLACE (i + 1 AS i), CAST(last_date + to_months(i + 1) AS TIMESTAMP) AS d FROM rec WHERE i < 6)))
SELECT series_key, i AS step, CAST(last_date + to_months(i) AS TIMESTAMP) AS date, round(v, 2) AS forecast,
       round(greatest(0.0, v - half), 2) AS lower, round(greatest(0.0, v + half), 2) AS upper, last_actual
FROM (SELECT *, rmse * 1.28::DOUBLE * (1 + 0.08::DOUBLE * (i - 1)) AS half FROM rec WHERE i > 0)""",
          {"forecast": 1, "lower": 1, "upper": 1, "last_actual": 4})
def q_recursive_forecast_fixed_by_brand(spark, sf):
    """G-01, G-03…G-05: six recursive steps of a scorer with fixed coefficients."""
    feats = brand_features(spark, sf)
    terms = " + ".join(f"{b}D * _x_{c}" for c, b in FIXED_COEFFICIENTS.items())
    model = SQLTransformer(statement=f"SELECT *, {FIXED_INTERCEPT}D + {terms} AS prediction FROM __THIS__")
    return recursive_forecast(feats, model, list(FIXED_COEFFICIENTS), es_fit(feats, KEYS).select(*KEYS, "rmse"), KEYS, horizon=6)


# ── report sections (H) ─────────────────────────────────────────────────────


def _m2(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', {x})"


def _m0(x: str) -> str:
    return f"'$' || format('{{:,.0f}}', {x})"


@register("report_summary_by_brand", f"""
WITH p AS ({S.SALES_BY_BRAND}),
a AS (SELECT series_key, count(*) AS n, round(sum(revenue), 4) AS total, round(avg(revenue), 4) AS mean,
             round(max(revenue), 4) AS mx, round(min(revenue), 4) AS mn, stddev_samp(revenue) AS sd,
             min(date) AS st, max(date) AS en FROM p GROUP BY series_key)
SELECT series_key, 1 AS line_no, 'Total Periods' AS label, CAST(n AS VARCHAR) AS value FROM a
UNION ALL SELECT series_key, 2, 'Total Revenue', {_m2('total')} FROM a
UNION ALL SELECT series_key, 3, 'Average Revenue', {_m2('mean')} FROM a
UNION ALL SELECT series_key, 4, 'Max Revenue', {_m2('mx')} FROM a
UNION ALL SELECT series_key, 5, 'Min Revenue', {_m2('mn')} FROM a
UNION ALL SELECT series_key, 6, 'Std Dev', {_m2('sd')} FROM a
UNION ALL SELECT series_key, 7, 'Start Date', strftime(st, '%Y-%m-%d') FROM a
UNION ALL SELECT series_key, 8, 'End Date', strftime(en, '%Y-%m-%d') FROM a""")
def q_report_summary_by_brand(spark, sf):
    """H-01: summary statistics section per brand."""
    return H.summary_section(fx.sales_by_brand(spark, sf), KEYS)


@register("report_forecast_section", f"""WITH {FC_CTE}
SELECT series_key, step, strftime(date, '%Y-%m-%d') AS date, forecast, lower, upper FROM fc""")
def q_report_forecast_section(spark, sf):
    """H-04: forecast section (smoothing forecast)."""
    return H.forecast_section(brand_es_forecast(spark, sf), KEYS)


@register("report_target_section", f"""WITH {TARGET_CTE}
SELECT series_key, 1 AS line_no, 'Target Revenue' AS label, {_m0('target')} AS value FROM v
UNION ALL SELECT series_key, 2, 'ML Forecast', {_m0('forecast')} FROM v
UNION ALL SELECT series_key, 3, 'Forecast Upper CI', {_m0('upper')} FROM v
UNION ALL SELECT series_key, 4, 'Forecast Lower CI', {_m0('lower')} FROM v
UNION ALL SELECT series_key, 5, 'Growth Required',
  CASE WHEN (target - last_actual) / NULLIF(last_actual, 0) * 100 >= 0 THEN '+' ELSE '' END ||
  replace(format('{{:,.1f}}', (target - last_actual) / NULLIF(last_actual, 0) * 100), ',', '') || '%' FROM v
UNION ALL SELECT series_key, 6, 'Check Period', 'Month ' || CAST(step AS VARCHAR) FROM v""")
def q_report_target_section(spark, sf):
    """H-07: target feasibility section."""
    fc = brand_es_forecast(spark, sf)
    return H.target_section(T.check_default_targets(fc, KEYS), KEYS)


@register("report_model_section")
def q_report_model_section(spark, sf):
    """H-03: model evaluation section over the full leaderboard."""
    return H.model_section(trained(spark, sf).metrics)


@register("run_summary")
def q_run_summary(spark, sf):
    """H-06: data points, best model, R², forecast total."""
    t = trained(spark, sf)
    feats = brand_features(spark, sf)
    return H.run_summary(feats, t.metrics, analysis.best_forecast(feats, t, KEYS))


@register("run_summary_es", f"""WITH {FC_CTE},
p AS (SELECT revenue AS actual, level AS predicted, avg(revenue) OVER () AS m FROM es2 WHERE is_test),
r2 AS (SELECT 1 - sum(pow(actual - predicted, 2)) / NULLIF(sum(pow(actual - m, 2)), 0) AS r2 FROM p),
pts AS (SELECT count(*) AS n FROM f),
tot AS (SELECT sum(forecast) AS t FROM fc)
SELECT n AS data_points, 'Exp.' AS best_model, r2 AS model_r2, t AS forecast_total,
       format('{{:,}}', n) AS data_points_text,
       replace(format('{{:,.3f}}', r2), ',', '') AS model_r2_text,
       '$' || replace(format('{{:,.1f}}', t / 1000), ',', '') || 'k' AS forecast_total_text
FROM pts, r2, tot""", {"model_r2": 6, "forecast_total": 2})
def q_run_summary_es(spark, sf):
    """H-06 with the smoothing model as the chosen model."""
    feats = brand_features(spark, sf)
    return H.run_summary(feats, leaderboard(es_metrics(feats, KEYS)), brand_es_forecast(spark, sf))



@register("report_lines_by_brand")
def q_report_lines_by_brand(spark, sf):
    """H-02: the text report (summary, models, cleaned data, forecast, importance) as ordered lines."""
    t = trained(spark, sf)
    feats = brand_features(spark, sf)
    return SK.report_lines({
        "summary": H.summary_section(fx.sales_by_brand(spark, sf), KEYS),
        "models": H.model_section(t.metrics),
        "cleaned": fx.sales_by_brand(spark, sf),
        "forecast": H.forecast_section(analysis.best_forecast(feats, t, KEYS), KEYS),
        "importance": H.importance_section(analysis.best_importance(feats, t, KEYS, fallback=False)),
    })


def _lines_sql(no: int, heading: str, source: str, columns: dict[str, str], order: str) -> str:
    """Lines of one section: heading, column names, rows; ``columns`` gives each column's text."""
    texts = ", ".join("CASE WHEN regexp_matches({v}, '[,\"\r\n]') THEN '\"' || replace({v}, '\"', '\"\"') || '\"' ELSE {v} END".format(
        v=f"coalesce({e}, '')") for e in columns.values())
    return f"""SELECT {no} AS section_no, 0::BIGINT AS line_no, '{heading}' AS text
UNION ALL SELECT {no}, 1, '{",".join(columns)}'
UNION ALL SELECT {no}, row_number() OVER (ORDER BY {order}) + 1, concat_ws(',', {texts}) FROM ({source})"""


def _varchar(*names):
    return {n: f"CAST({n} AS VARCHAR)" for n in names}


_CLEAN_2 = f"""SELECT * REPLACE (printf('%.2f', revenue) AS revenue, printf('%.2f', units_sold) AS units_sold, printf('%.2f', price) AS price)
FROM ({S.CLEAN_DIRTY_DAILY})"""


@register("report_lines_es_by_brand", f"""
SELECT 0 AS section_no, 0::BIGINT AS line_no, '{SK.TITLE}' AS text UNION ALL
{_lines_sql(1, SK.HEADINGS['summary'], ORACLE['report_summary_by_brand'], _varchar('series_key', 'line_no', 'label', 'value'), 'series_key, line_no')} UNION ALL
{_lines_sql(2, SK.HEADINGS['cleaned'], _CLEAN_2, _varchar('series_key', 'date', 'revenue', 'units_sold', 'price', 'seq'), 'series_key, date, seq')} UNION ALL
{_lines_sql(3, SK.HEADINGS['forecast'], ORACLE['report_forecast_section'], _varchar('series_key', 'step', 'date', 'forecast', 'lower', 'upper'), 'series_key, step')}""")
def q_report_lines_es_by_brand(spark, sf):
    """H-02, C-13: report lines of the smoothing path, the cleaned rows in order, numbered without gaps."""
    from panelcast.operators.clean import clean_sales
    clean = clean_sales(fx.dirty_daily_by_brand(spark, sf), KEYS, seq="seq")[0]
    return SK.report_lines({
        "summary": H.summary_section(fx.sales_by_brand(spark, sf), KEYS),
        "models": None,
        "cleaned": clean.withColumns({c: fixed(F.col(c), 2) for c in ("revenue", "units_sold", "price")}),
        "forecast": H.forecast_section(brand_es_forecast(spark, sf), KEYS),
    })


@register("model_series_metrics")
def q_model_series_metrics(spark, sf):
    """M-12 per (model, brand): the hold-out errors that set each forecast band."""
    from panelcast.operators.training import series_metrics
    return series_metrics(trained(spark, sf).predictions, KEYS)
