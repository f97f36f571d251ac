"""The query catalog over the given tables (see ``catalog.register``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators.clean import clean_sales
from panelcast.operators.features import add_features
from panelcast.operators.long_features import add_long_features
from panelcast.plans import sql_fixtures as S
from panelcast.plans.catalog import register
from panelcast.sources import fixtures as fx

MONEY = 2
RATIO = 6

# Panel sums are whole numbers of the last decimal place on both sides, so
# IEEE-identical expressions need no rounding. Other sums of doubles differ in
# their last bits by the order of the rows; means of up to 6 four-place amounts
# are rounded at 6 places (never a tie there), irrational results (std, sin,
# cos) well inside their error.
PANEL_ROUND: dict[str, int] = {}
FEATURE_ROUND = {"month_sin": RATIO, "month_cos": RATIO, "rolling_mean_3": RATIO,
                 "rolling_mean_6": RATIO, "rolling_std_3": MONEY}

# ── fixtures (C-14 roll-ups) ────────────────────────────────────────────────


@register("sales_by_brand", S.SALES_BY_BRAND, PANEL_ROUND)
def q_sales_by_brand(spark, sf):
    return fx.sales_by_brand(spark, sf)


@register("sales_total", S.SALES_TOTAL, PANEL_ROUND)
def q_sales_total(spark, sf):
    return fx.sales_total(spark, sf)


@register("sales_by_nation", S.SALES_BY_NATION, PANEL_ROUND)
def q_sales_by_nation(spark, sf):
    return fx.sales_by_nation(spark, sf)


@register("orders_by_priority", S.ORDERS_BY_PRIORITY, PANEL_ROUND)
def q_orders_by_priority(spark, sf):
    return fx.orders_by_priority(spark, sf)


@register("event_value_daily", S.EVENT_VALUE_DAILY, PANEL_ROUND)
def q_event_value_daily(spark, sf):
    return fx.event_value_daily(spark, sf)


# ── features (D-01…D-09) ────────────────────────────────────────────────────


@register("features_by_brand", S.features_sql(S.SALES_BY_BRAND, ["series_key"]), FEATURE_ROUND)
def q_features_by_brand(spark, sf):
    """Flagship: lineitem ⨝ part → monthly brand panel → 14 features."""
    return add_features(fx.sales_by_brand(spark, sf), ["series_key"])


@register("features_total", S.features_sql(S.SALES_TOTAL, []), FEATURE_ROUND)
def q_features_total(spark, sf):
    return add_features(fx.sales_total(spark, sf), [])


@register("features_by_nation", S.features_sql(S.SALES_BY_NATION, ["series_key"]), FEATURE_ROUND)
def q_features_by_nation(spark, sf):
    return add_features(fx.sales_by_nation(spark, sf), ["series_key"])


@register("features_event_daily", S.features_sql(S.EVENT_VALUE_DAILY, ["series_key"]), FEATURE_ROUND)
def q_features_event_daily(spark, sf):
    return add_features(fx.event_value_daily(spark, sf), ["series_key"])


# ── cleaning (B-01…B-04, C-01…C-13) ─────────────────────────────────────────

CLEAN_ROUND: dict[str, int] = {}


def cleaned_daily(spark, sf):
    return clean_sales(fx.dirty_daily_by_brand(spark, sf), ["series_key"], seq="seq")


@register("clean_dirty_daily", S.CLEAN_DIRTY_DAILY, CLEAN_ROUND)
def q_clean_dirty_daily(spark, sf):
    """Role detection, parsing, coercion, drop, fills and IQR capping."""
    return cleaned_daily(spark, sf)[0]


@register("clean_log_dirty_daily", S.CLEAN_LOG_DIRTY_DAILY)
def q_clean_log_dirty_daily(spark, sf):
    """C-12 validation log for the same table."""
    return cleaned_daily(spark, sf)[1]


@register("features_clean_daily",
          S.features_sql(S.CLEAN_DIRTY_DAILY, ["series_key"], ("seq",)),
          {**FEATURE_ROUND, "rolling_mean_3": 7, "rolling_mean_6": 7})
def q_features_clean_daily(spark, sf):
    """Cleaned daily panel → features (the reference's step 1 end to end)."""
    return add_long_features(cleaned_daily(spark, sf)[0], ["series_key"])


@register("clean_skewed_lines", S.clean_sql(S.SKEWED_RAW, "series_key"), CLEAN_ROUND)
def q_clean_skewed_lines(spark, sf):
    """Raw lines with a hot series, a hot price and missing keys."""
    return clean_sales(fx.skewed_lines(spark, sf), ["series_key"], fx.SKEWED_ROLES, seq="seq")[0]


@register("clean_skewed_total", S.clean_sql(S.SKEWED_RAW, None), CLEAN_ROUND)
def q_clean_skewed_total(spark, sf):
    """The same lines as one series."""
    return clean_sales(fx.skewed_lines(spark, sf).drop("series_key"), [], fx.SKEWED_ROLES, seq="seq")[0]


@register("features_skewed_total", S.features_sql(S.clean_sql(S.SKEWED_RAW, None), [], ("seq",)),
          {**FEATURE_ROUND, "rolling_mean_3": 7, "rolling_mean_6": 7, "growth_rate": 6})
def q_features_skewed_total(spark, sf):
    """Features of raw lines as one series, many of one day."""
    return add_long_features(clean_sales(fx.skewed_lines(spark, sf).drop("series_key"), [], fx.SKEWED_ROLES, seq="seq")[0], [])


# ── date layouts (C-01) ─────────────────────────────────────────────────────


def _cleaned_with_dates(spark, sf, fmt: str, with_time: bool):
    """The raw table with its dates written in another layout, cleaned."""
    raw = fx.dirty_daily_by_brand(spark, sf)
    day = F.to_timestamp("order_day", "yyyy-MM-dd")
    when = day + F.make_dt_interval(hours=(F.col("seq") % 24).cast("int")) if with_time else day
    return clean_sales(raw.withColumn("order_day", F.date_format(when, fmt)), ["series_key"], seq="seq")[0]


CLEAN_TIMED = f"SELECT * REPLACE (date + to_hours(CAST(seq % 24 AS INTEGER)) AS date) FROM ({S.CLEAN_DIRTY_DAILY})"


@register("clean_dates_month_first", S.CLEAN_DIRTY_DAILY, CLEAN_ROUND)
def q_clean_dates_month_first(spark, sf):
    """Dates as 1/5/2024."""
    return _cleaned_with_dates(spark, sf, "M/d/yyyy", False)


@register("clean_dates_zoned", CLEAN_TIMED, CLEAN_ROUND)
def q_clean_dates_zoned(spark, sf):
    """Dates as 2024-01-05T10:00:00.000Z, the time kept."""
    return _cleaned_with_dates(spark, sf, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", True)


@register("clean_dates_timed", CLEAN_TIMED, CLEAN_ROUND)
def q_clean_dates_timed(spark, sf):
    """Dates as 2024-1-5 9:30:00, the time kept."""
    return _cleaned_with_dates(spark, sf, "yyyy-M-d H:mm:ss", True)


@register("clean_dates_named_month", S.CLEAN_DIRTY_DAILY, CLEAN_ROUND)
def q_clean_dates_named_month(spark, sf):
    """Dates as 05-Jan-2024."""
    return _cleaned_with_dates(spark, sf, "dd-MMM-yyyy", False)


@register("clean_dates_short_half_day", CLEAN_TIMED, CLEAN_ROUND)
def q_clean_dates_short_half_day(spark, sf):
    """Dates as 1/5/24 10:30 PM, with years of two digits."""
    return _cleaned_with_dates(spark, sf, "M/d/yy h:mm a", True)


@register("clean_dates_mail", CLEAN_TIMED, CLEAN_ROUND)
def q_clean_dates_mail(spark, sf):
    """Dates as Fri, 05 Jan 2024 10:00:00 +0000."""
    return _cleaned_with_dates(spark, sf, "EEE, dd MMM yyyy HH:mm:ss Z", True)


# ── previews (A-06, A-07) ───────────────────────────────────────────────────


@register("raw_preview", f"SELECT * FROM ({S.DIRTY_DAILY_BY_BRAND}) ORDER BY series_key, seq LIMIT 10")
def q_raw_preview(spark, sf):
    """First 10 raw rows in original order (a distributed top-k, not a collect)."""
    return fx.dirty_daily_by_brand(spark, sf).orderBy("series_key", "seq").limit(10)


@register("feature_preview",
          f"SELECT * FROM ({S.features_sql(S.SALES_BY_BRAND, ['series_key'])}) "
          "ORDER BY series_key, date LIMIT 12", FEATURE_ROUND)
def q_feature_preview(spark, sf):
    return add_features(fx.sales_by_brand(spark, sf), ["series_key"]) \
        .orderBy("series_key", "date").limit(12)


@register("clean_from_csv", S.CLEAN_DIRTY_DAILY, CLEAN_ROUND)
def q_clean_from_csv(spark, sf):
    """A-01 then C: the raw table written as CSV (header) under the shared
    checkpoint folder, scanned with schema inference, then cleaned."""
    import os
    import uuid

    from panelcast.session import ensure_checkpoint_dir
    from panelcast.sources.tables import read_sales_file
    path = os.path.join(ensure_checkpoint_dir(spark), "sales_csv", uuid.uuid4().hex)
    fx.dirty_daily_by_brand(spark, sf).write.option("header", True).csv(path)
    raw = read_sales_file(spark, path, fmt="csv")
    clean = clean_sales(raw, ["series_key"], seq="seq")[0]
    return clean.withColumn("seq", F.col("seq").cast("bigint"))


def cleaned_daily_chunked(spark, sf):
    return clean_sales(fx.dirty_daily_by_brand(spark, sf), ["series_key"], seq="seq", chunk_rows=64)


@register("clean_dirty_daily_chunked", S.CLEAN_DIRTY_DAILY, CLEAN_ROUND)
def q_clean_dirty_daily_chunked(spark, sf):
    """C-01…C-13 with every series split into chunks of 64 positions (same result)."""
    return cleaned_daily_chunked(spark, sf)[0]


@register("clean_log_dirty_daily_chunked", S.CLEAN_LOG_DIRTY_DAILY)
def q_clean_log_dirty_daily_chunked(spark, sf):
    return cleaned_daily_chunked(spark, sf)[1]
