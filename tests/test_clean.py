"""Cleaning (B, C) on small frames against pandas written here."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.functions.roles import detect_role, resolve_roles, ROLE_PATTERNS
from panelcast.operators.clean import clean_sales


def _clean(spark, pdf, schema=None, **kw):
    df = spark.createDataFrame(pdf, schema) if schema else spark.createDataFrame(pdf)
    clean, log = clean_sales(df, **kw)
    return clean.orderBy("date", "seq").toPandas(), log.orderBy("seq").toPandas()


def test_wide_names_role_order(spark):
    cols = ["unit_price", "qty", "Discount", "Sales", "order_date"]
    assert detect_role(cols, ROLE_PATTERNS["units"]) == "unit_price"   # first in table order
    assert detect_role(["Discount"], ROLE_PATTERNS["units"]) == "Discount"  # contains "count"
    df = spark.createDataFrame([(1.0, 2, 0.1, 5.0, "2020-01-01")], cols)
    roles = resolve_roles(df)
    assert roles["date"] == "order_date" and roles["revenue"] == "Sales"
    assert roles["price"] == "unit_price"


def test_fallbacks(spark):
    df = spark.createDataFrame([("x", 3, 4.0)], "label string, a long, b double")
    roles = resolve_roles(df)
    assert roles["date"] == "label" and roles["date_how"] == "fallback"
    assert roles["revenue"] == "a" and roles["revenue_how"] == "fallback"


def test_gaps_units_ffill_then_median(spark):
    units = [None, 4.0, None, 6.0, None, None, 10.0, None]
    pdf = pd.DataFrame({"Date": [f"2020-0{i + 1}-01" for i in range(8)],
                        "Revenue": [100.0 + i for i in range(8)], "Units_Sold": units,
                        "seq": list(range(8))})
    got, _ = _clean(spark, pdf, "Date string, Revenue double, Units_Sold double, seq long")
    want = pd.Series(units).ffill().fillna(pd.Series(units).median())
    assert got["units_sold"].tolist() == want.tolist()


def test_all_null_units_stay_null(spark):
    pdf = pd.DataFrame({"Date": [f"2020-0{i + 1}-01" for i in range(6)],
                        "Revenue": [1.0] * 6, "Units_Sold": [None] * 6, "seq": list(range(6))})
    got, _ = _clean(spark, pdf, "Date string, Revenue double, Units_Sold double, seq long")
    assert got["units_sold"].isna().all()


def test_outliers_fenced_and_clipped(spark):
    rev = [100.0 + (i % 7) for i in range(30)]
    rev[5], rev[9] = 10_000.0, -50.0
    pdf = pd.DataFrame({"Date": pd.date_range("2020-01-01", periods=30, freq="D").strftime("%Y-%m-%d"),
                        "Revenue": rev, "seq": list(range(30))})
    got, log = _clean(spark, pdf, "Date string, Revenue double, seq long")
    s = pd.Series(rev)
    q1, q3 = s.quantile([0.25, 0.75])
    hi, lo = q3 + 3 * (q3 - q1), max(0, q1 - 3 * (q3 - q1))
    np.testing.assert_allclose(got["revenue"].to_numpy(), s.clip(lo, hi).to_numpy())
    assert any("Capped 2 revenue outliers" in m for m in log["msg"])


def test_constant_revenue_has_zero_iqr(spark):
    pdf = pd.DataFrame({"Date": [f"2020-{m:02d}-01" for m in range(1, 13)], "Revenue": [5.0] * 12,
                        "seq": list(range(12))})
    got, log = _clean(spark, pdf, "Date string, Revenue double, seq long")
    assert got["revenue"].tolist() == [5.0] * 12
    assert not any("Capped" in m for m in log["msg"])


def test_mixed_dates_regenerate(spark):
    pdf = pd.DataFrame({"Date": ["2020-01-01", "01/02/2020", "2020-03-01", "bad", "2020-05-01"],
                        "Revenue": [1.0, 2.0, 3.0, 4.0, 5.0], "seq": list(range(5))})
    got, log = _clean(spark, pdf, "Date string, Revenue double, seq long")
    assert [str(d.date()) for d in got["date"]] == ["2022-01-01", "2022-02-01", "2022-03-01",
                                                    "2022-04-01", "2022-05-01"]
    assert "error" in log["type"].tolist()


def test_dup_dates_tie_break_by_seq(spark):
    pdf = pd.DataFrame({"Date": ["2020-01-01"] * 3 + ["2020-02-01"] * 3,
                        "Revenue": [6.0, 5.0, 4.0, 3.0, 2.0, 1.0], "seq": [5, 4, 3, 2, 1, 0]})
    got, _ = _clean(spark, pdf, "Date string, Revenue double, seq long")
    assert got["revenue"].tolist() == [4.0, 5.0, 6.0, 1.0, 2.0, 3.0]


def test_drop_and_log_counts(spark):
    pdf = pd.DataFrame({"Date": ["2020-01-01", None, "2020-03-01", "2020-04-01"],
                        "Revenue": ["10", "20", "n/a", "40"], "Qty": [1, 2, 3, 4],
                        "seq": [0, 1, 2, 3]})
    got, log = _clean(spark, pdf, "Date string, Revenue string, Qty long, seq long")
    assert got["revenue"].tolist() == [10.0, 40.0]
    assert got["price"].tolist() == [10.0, 10.0]            # derived revenue / units
    msgs = log["msg"].tolist()
    assert msgs[0] == "Loaded 4 rows and 4 columns."
    assert "Removed 2 rows with missing Date or Revenue." in msgs
    assert msgs[-1] == "Cleaning complete. 2 clean rows ready."


@pytest.mark.parametrize("rows", [0, 1])
def test_empty_and_one_row(spark, rows):
    pdf = pd.DataFrame({"Date": ["2020-01-01"][:rows], "Revenue": [1.0][:rows], "seq": [0][:rows]})
    got, log = _clean(spark, pdf, "Date string, Revenue double, seq long")
    assert len(got) == rows
    assert log["msg"].iloc[-1] == f"Cleaning complete. {rows} clean rows ready."


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([("2020-01-01", float("nan"), 0), ("2020-02-01", 2.0, 1)],
                               "Date string, Revenue double, seq long")
    clean, _ = clean_sales(df)
    assert clean.count() == 1
    assert clean.filter(F.isnan("revenue")).count() == 0


@pytest.mark.parametrize("texts, want", [
    (["1/5/2024", "12/31/2024"], ["2024-01-05 00:00:00", "2024-12-31 00:00:00"]),
    (["13/5/2024", "1/12/2024"], ["2024-05-13 00:00:00", "2024-12-01 00:00:00"]),
    (["2024-1-5", "2024-11-25"], ["2024-01-05 00:00:00", "2024-11-25 00:00:00"]),
    (["2024-01-05T10:00:00Z", "2024-01-05T10:30:00+02:00"], ["2024-01-05 10:00:00", "2024-01-05 08:30:00"]),
    (["2024-01-05 10:30:00.25", "2024-01-05 09:30"], ["2024-01-05 10:30:00.250000", "2024-01-05 09:30:00"]),
    (["1/5/2024 9:05", "1/6/2024"], ["2024-01-05 09:05:00", "2024-01-06 00:00:00"]),
    (["5 Jan 2024", "15 Feb 2024"], ["2024-01-05 00:00:00", "2024-02-15 00:00:00"]),
])
def test_date_layouts_keep_the_time(spark, texts, want):
    df = spark.createDataFrame([(i, t, 1.0 + i) for i, t in enumerate(texts)], "seq long, Date string, Revenue double")
    got = clean_sales(df, [], seq="seq")[0].orderBy("seq").collect()
    assert [str(r["date"]) for r in got] == want


def test_ordered_output(spark):
    """C-13: rows sorted by series, date and position, as read back."""
    rows = [(k, i, f"2024-01-{1 + (i * 7) % 28:02d}", float(i)) for k in ("b", "a", None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, seq long, Date string, Revenue double").repartition(5)
    got = [(r["k"] or "", r["date"], r["seq"]) for r in clean_sales(df, ["k"], seq="seq", ordered=True)[0].collect()]
    assert got == sorted(got) and len(got) == 180
