"""Catalog entries for EDA (E), activity (F) and text (H-05) operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions import text as T
from panelcast.operators import activity as A
from panelcast.operators import eda
from panelcast.operators.features import add_features
from panelcast.plans import sql_fixtures as S
from panelcast.plans.catalog import register
from panelcast.plans.queries import cleaned_daily
from panelcast.sources import fixtures as fx

KEYS = ["series_key"]
FEAT = S.features_sql(S.SALES_BY_BRAND, KEYS)


def brand_features(spark, sf):
    return add_features(fx.sales_by_brand(spark, sf), KEYS)


@register("eda_summary", f"""
WITH f AS ({FEAT})
SELECT series_key, count(*) AS n_periods, sum(revenue) AS total_revenue, avg(revenue) AS mean_revenue,
       max(revenue) AS peak_revenue, min(revenue) AS min_revenue, stddev_samp(revenue) AS std_revenue,
       stddev_pop(revenue) / NULLIF(avg(revenue), 0) * 100 AS cv_pct,
       coalesce(avg(growth_rate), 0.0) AS avg_growth, min(date) AS start_date, max(date) AS end_date
FROM f GROUP BY series_key""", {"total_revenue": 4, "mean_revenue": 2, "peak_revenue": 4, "min_revenue": 4, "std_revenue": 2,
                                "cv_pct": 6, "avg_growth": 6})
def q_eda_summary(spark, sf):
    """E-01…E-04, E-13: KPIs, peak/min, CV, average growth, report summary."""
    return eda.summary(brand_features(spark, sf), KEYS)


@register("eda_moving_average", f"""
WITH f AS ({FEAT})
SELECT series_key, date, revenue,
       CASE WHEN count(*) OVER (PARTITION BY series_key) >= 3 THEN
            avg(revenue) OVER (PARTITION BY series_key ORDER BY date
                               ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS ma_3
FROM f""", {"revenue": 4, "ma_3": 6})
def q_eda_moving_average(spark, sf):
    """E-05: trailing 3-period mean."""
    return eda.moving_average(brand_features(spark, sf), KEYS)


SEASON_SQL = f"""
SELECT series_key, CAST(month(date) AS INTEGER) AS month, avg(revenue) AS avg_revenue,
       strftime(make_date(2000, CAST(month(date) AS INTEGER), 1), '%b') AS month_name
FROM f GROUP BY series_key, month(date)"""


@register("eda_seasonality", f"WITH f AS ({FEAT}) {SEASON_SQL}", {"avg_revenue": 6})
def q_eda_seasonality(spark, sf):
    """E-06: mean revenue by calendar month."""
    return eda.seasonality(brand_features(spark, sf), KEYS)


@register("eda_peak_month", f"""
WITH f AS ({FEAT}), s AS ({SEASON_SQL})
SELECT series_key, first(month_name ORDER BY avg_revenue DESC, month ASC) AS peak_month,
       max(avg_revenue) AS peak_avg_revenue
FROM s GROUP BY series_key""", {"peak_avg_revenue": 6})
def q_eda_peak_month(spark, sf):
    """E-07: best month per brand (earlier month on ties)."""
    return eda.peak_month(brand_features(spark, sf), KEYS)


@register("eda_trendline", f"""
WITH f AS ({FEAT})
SELECT series_key, regr_slope(revenue, units_sold) AS slope,
       regr_intercept(revenue, units_sold) AS intercept, regr_r2(revenue, units_sold) AS r2,
       CAST(regr_count(revenue, units_sold) AS BIGINT) AS n
FROM f GROUP BY series_key""", {"slope": 6, "intercept": 2, "r2": 6})
def q_eda_trendline(spark, sf):
    """E-08: OLS revenue ~ units per brand."""
    return eda.trendline(brand_features(spark, sf), KEYS)


def _corr_sql() -> str:
    cols = eda.CORR_COLUMNS
    parts = [f"SELECT series_key, '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS corr FROM f GROUP BY series_key"
             for a in cols for b in cols]
    return f"WITH f AS ({FEAT}) " + " UNION ALL ".join(parts)


@register("eda_correlation", _corr_sql(), {"corr": 6})
def q_eda_correlation(spark, sf):
    """E-09: Pearson matrix over revenue, units, price, growth, lag 1 (long form)."""
    return eda.correlation(brand_features(spark, sf), KEYS)


@register("eda_observations", f"""
WITH f AS ({FEAT}), s AS ({SEASON_SQL}),
pk AS (SELECT series_key, first(month_name ORDER BY avg_revenue DESC, month ASC) AS peak_month
       FROM s GROUP BY series_key),
k AS (SELECT series_key, coalesce(avg(growth_rate), 0.0) AS g,
             stddev_pop(revenue) / NULLIF(avg(revenue), 0) * 100 AS cv
      FROM f GROUP BY series_key),
j AS (SELECT * FROM k JOIN pk USING (series_key))
SELECT series_key, 1 AS seq, 'info' AS type,
       printf('{eda.NOTE_PEAK}', peak_month) AS text
FROM j
UNION ALL
SELECT series_key, 2, CASE WHEN g > 0 THEN 'success' ELSE 'danger' END,
       printf('{eda.NOTE_GROWTH}', g,
              CASE WHEN g > 0 THEN '{eda.TREND_UP}' ELSE '{eda.TREND_DOWN}' END) FROM j
UNION ALL
SELECT series_key, 3, CASE WHEN cv > 20 THEN 'warning' ELSE 'success' END,
       printf('{eda.NOTE_SPREAD}', cv,
              CASE WHEN cv > 20 THEN '{eda.SPREAD_WIDE}' ELSE '{eda.SPREAD_NARROW}' END) FROM j""")
def q_eda_observations(spark, sf):
    """E-10: peak month, growth sign and volatility notes."""
    return eda.observations(brand_features(spark, sf), KEYS)


@register("eda_sparkline", f"""
WITH c AS ({S.CLEAN_DIRTY_DAILY}),
st AS (SELECT series_key, min(revenue) AS min_revenue, max(revenue) AS max_revenue,
              arg_min(revenue, seq) AS first_revenue, arg_max(revenue, seq) AS last_revenue
       FROM c GROUP BY series_key)
SELECT *, CASE WHEN first_revenue = 0 THEN 0.0
               ELSE (last_revenue - first_revenue) / first_revenue * 100 END AS pct_change,
       CASE WHEN (CASE WHEN first_revenue = 0 THEN 0.0
                  ELSE (last_revenue - first_revenue) / first_revenue * 100 END) >= 0
            THEN '↑' ELSE '↓' END AS arrow
FROM st""", {"min_revenue": 6, "max_revenue": 6, "first_revenue": 6, "last_revenue": 6,
             "pct_change": 6})
def q_eda_sparkline(spark, sf):
    """E-11: sidebar stats of each cleaned series."""
    return eda.sparkline(cleaned_daily(spark, sf)[0], KEYS)


@register("data_health", f"""
WITH r AS (SELECT series_key, count(*) AS raw_rows FROM ({S.DIRTY_DAILY_BY_BRAND}) GROUP BY series_key),
c AS (SELECT series_key, count(*) AS clean_rows FROM ({S.CLEAN_DIRTY_DAILY}) GROUP BY series_key),
j AS (SELECT r.series_key, raw_rows, coalesce(clean_rows, 0) AS clean_rows
      FROM r LEFT JOIN c ON r.series_key = c.series_key),
sc AS (SELECT *, CAST(greatest(0, least(100, round_even(least(100.0, clean_rows * 100.0 /
              greatest(raw_rows, 1)), 0))) AS INTEGER) AS score FROM j)
SELECT *, CASE WHEN score >= 85 THEN 'Excellent' WHEN score >= 65 THEN 'Good'
               ELSE 'Needs Work' END AS label FROM sc""")
def q_data_health(spark, sf):
    """E-12: completeness score and band per brand."""
    return eda.data_health(fx.dirty_daily_by_brand(spark, sf), cleaned_daily(spark, sf)[0], KEYS)


# ── activity log (F-01…F-05) over events ────────────────────────────────────

EVENT_ACTIONS = ["view", "click", "purchase", "signup", "error"]
ACT = S.ACTIVITY_EVENTS


@register("activity_counts", "SELECT count(*) AS total_events, " + ", ".join(
    f"count(*) FILTER (WHERE action = '{a}') AS n_{a}" for a in EVENT_ACTIONS) + f" FROM ({ACT})")
def q_activity_counts(spark, sf):
    """F-01: total and per-action counts."""
    return A.activity_counts(fx.activity_events(spark, sf), EVENT_ACTIONS)


@register("activity_view",
          f"SELECT * FROM ({ACT}) WHERE action = 'purchase' AND role = 'analyst'")
def q_activity_view(spark, sf):
    """F-02/F-03: purchases by analysts, most recent first."""
    return A.activity_view(fx.activity_events(spark, sf), action="purchase", role="analyst")


@register("activity_footer", f"""
SELECT count(*) FILTER (WHERE action = 'signup' AND role = 'viewer') AS shown, count(*) AS total,
       printf('Showing %d of %d events', count(*) FILTER (WHERE action = 'signup' AND role = 'viewer'),
              count(*)) AS footer
FROM ({ACT})""")
def q_activity_footer(spark, sf):
    """F-04: "k of n" for one filter."""
    return A.activity_footer(fx.activity_events(spark, sf), action="signup", role="viewer")


@register("activity_timestamps",
          f"SELECT *, strftime(ts, '%d %b %Y  %H:%M:%S') AS timestamp FROM ({ACT})")
def q_activity_timestamps(spark, sf):
    """F-05: log timestamp text."""
    return A.with_log_timestamp(fx.activity_events(spark, sf))


@register("activity_by_action_role",
          f"SELECT action, role, count(*) AS events FROM ({ACT}) GROUP BY action, role")
def q_activity_by_action_role(spark, sf):
    return A.activity_by_action_role(fx.activity_events(spark, sf))


# ── text cleaner (H-05) over pages ──────────────────────────────────────────


def _text_sql(col: str) -> str:
    e = f"regexp_replace({col}, '{T.TAG_PATTERN}', '', 'g')"
    e = f"regexp_replace({e}, '{T.NON_ASCII_PATTERN}', '', 'g')"
    return f"regexp_replace({e}, '{T.OUTER_SPACE_PATTERN}', '', 'g')"


@register("html_text", f"SELECT page_id, url, {_text_sql('html')} AS text FROM pages")
def q_html_text(spark, sf):
    """H-05 over every page: tags, non-ASCII and outer whitespace removed."""
    from panelcast.sources.tables import table
    return table(spark, sf, "pages").select("page_id", "url", T.clean_text("html").alias("text"))


@register("activity_log_positions", f"""
SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, strftime(ts, '%d %b %Y  %H:%M:%S') AS timestamp, username, action FROM ({ACT})""")
def q_activity_log_positions(spark, sf):
    """A-04, A-03, F-03: the log appended in three jobs of several files each, read back; its
    places are those of the appended entries."""
    import os
    import uuid

    from panelcast.operators.chunked import KEY, series_key
    from panelcast.operators.long_features import positions
    from panelcast.session import ensure_checkpoint_dir
    from panelcast.sources.activity_log import append_activity, read_activity_log
    path = os.path.join(ensure_checkpoint_dir(spark), "activity_log", uuid.uuid4().hex)
    events = fx.activity_events(spark, sf)
    low, high = events.agg(F.percentile_approx("event_id", [0.3, 0.7])).first()[0]
    for part in ("event_id < %d" % low, "event_id >= %d AND event_id < %d" % (low, high), "event_id >= %d" % high):
        append_activity(events.where(part).orderBy("event_id"), path)
    log = positions(read_activity_log(spark, path).withColumn(KEY, series_key([])), ["pos"])
    return log.select(F.col("_pos").alias("place"), "timestamp", "username", "action")


@register("activity_log_roundtrip", f"""
SELECT strftime(ts, '%d %b %Y  %H:%M:%S') AS timestamp, username, name, action, role,
       strptime(strftime(ts, '%d %b %Y  %H:%M:%S'), '%d %b %Y  %H:%M:%S') AS ts
FROM ({ACT})""")
def q_activity_log_roundtrip(spark, sf):
    """A-04 then A-03: append the log as JSON lines under the shared checkpoint
    folder, read it back with the explicit schema (timestamps at 1 s)."""
    import os
    import uuid

    from panelcast.session import ensure_checkpoint_dir
    from panelcast.sources.activity_log import append_activity, read_activity_log
    path = os.path.join(ensure_checkpoint_dir(spark), "activity_log", uuid.uuid4().hex)
    append_activity(fx.activity_events(spark, sf), path)
    return read_activity_log(spark, path).drop("pos").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
