"""Chunked per-series scans and cleaning against pandas and whole-series aggregates."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators import chunked as C
from panelcast.operators.clean import clean_sales
from panelcast.sources import fixtures as fx


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k, n in [("A", 600), ("B", 37), ("C", 1), (None, 50)]:
        for i in range(n):
            v = None if rng.random() < 0.3 else float(rng.integers(0, 50))
            rows.append((k, i * 3, v))
    return rows, spark.createDataFrame(rows, "k string, s long, v double")


@pytest.mark.parametrize("chunk", [1, 16, 1 << 16])
def test_forward_fill_and_row_numbers(spark, gappy, chunk):
    rows, df = gappy
    pdf = pd.DataFrame(rows, columns=["k", "s", "v"]).fillna({"k": "~"}).sort_values(["k", "s"])
    named = [F.coalesce("k", F.lit("~")), "s"]
    ff = C.forward_fill(df, ["v"], ["k"], "s", chunk).orderBy(*named).toPandas()
    want = pdf.groupby("k")["v"].ffill()
    np.testing.assert_array_equal(ff["v"].fillna(-1).to_numpy(), want.fillna(-1).to_numpy())
    rn = C.row_numbers(df, ["k"], "s", chunk).orderBy(*named).toPandas()
    assert (rn["_rn"].to_numpy() == pdf.groupby("k").cumcount().to_numpy() + 1).all()


def test_order_of_another_type(spark, gappy):
    rows, df = gappy
    text = df.withColumn("s", F.format_string("%08d", "s"))
    a = C.row_numbers(text, ["k"], "s", 16).select("k", "_rn", "v")
    b = C.row_numbers(df, ["k"], "s", 16).select("k", "_rn", "v")
    assert a.exceptAll(b).count() == 0


def same_as_percentile(spark, df, specs):
    got = C.quantiles(df.withColumn(C.KEY, C.series_key(["k"])), specs).select(f"{C.KEY}.k", *[n for _, _, n in specs])
    want = df.groupBy("k").agg(*[F.percentile(c, F.lit(q)).alias(n) for c, q, n in specs])
    have = {r["k"]: r for r in got.collect()}
    for r in want.collect():
        values = [r[n] for _, _, n in specs]
        assert [have[r["k"]][n] for _, _, n in specs] == values if r["k"] in have else values == [None] * len(specs)


QS = [("v", 0.5, "med"), ("v", 0.25, "q1"), ("v", 0.75, "q3"), ("v", 0.0, "mn"), ("v", 1.0, "mx")]


def test_quantiles_equal_percentile(spark, gappy):
    same_as_percentile(spark, gappy[1], QS)


def test_quantiles_of_odd_values(spark):
    """Values of all magnitudes, close neighbours, one huge tie, no values at all."""
    rng = np.random.default_rng(3)
    rows = [("mixed", float(x)) for x in np.r_[rng.normal(size=300), 10.0 ** rng.uniform(-300, 300, 300), -10.0 ** rng.uniform(-9, 9, 300), 0.0, -0.0]]
    rows += [("near", float(np.nextafter(1e5, 2e5) + i * 2e-11)) for i in range(400)] + [("near", 1e5 + i) for i in range(3)]
    rows += [("tie", 7.25)] * 500 + [("tie", 7.5)] * 3 + [("none", None)] * 4 + [("one", 3.0)] + [(None, float(i)) for i in range(9)]
    rows += [("ends", x) for x in (1.7e308, -1.7e308, 1.0, float("inf"), 5e-324)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    same_as_percentile(spark, df, [(c, q, n) for c, q, n in QS if n != "mx"] + [("v", 0.9, "high")])


def _both(spark, pdf, schema, **kw):
    df = spark.createDataFrame(pdf, schema)
    a = clean_sales(df, **kw)
    b = clean_sales(df, chunk_rows=2, **kw)
    return [x.orderBy("seq").toPandas() for x in (a[0], b[0])], \
        [x.orderBy("seq").toPandas() for x in (a[1], b[1])]


def test_single_series_in_chunks(spark):
    rev = [100.0 + (i % 7) for i in range(30)]
    rev[5], rev[9] = 10_000.0, -50.0
    units = [None if i % 4 == 0 else float(i) for i in range(30)]
    pdf = pd.DataFrame({"Date": pd.date_range("2020-01-01", periods=30, freq="D").strftime("%Y-%m-%d"),
                        "Revenue": rev, "Units_Sold": units, "seq": range(30)})
    (a, b), (la, lb) = _both(spark, pdf, "Date string, Revenue double, Units_Sold double, seq long")
    pd.testing.assert_frame_equal(a, b)
    pd.testing.assert_frame_equal(la, lb)
    want = pd.Series(units).ffill().fillna(pd.Series(units).median())
    assert a["units_sold"].tolist() == want.tolist()


def test_regenerated_dates_in_chunks(spark):
    pdf = pd.DataFrame({"Date": ["2020-01-01", "bad", "2020-03-01", "x", "2020-05-01"],
                        "Revenue": [1.0, None, 3.0, 4.0, 5.0], "seq": [0, 1, 2, 3, 4]})
    (a, b), _ = _both(spark, pdf, "Date string, Revenue double, seq long")
    pd.testing.assert_frame_equal(a, b)
    assert [str(d.date()) for d in b["date"]] == ["2022-01-01", "2022-03-01", "2022-04-01", "2022-05-01"]
    (a, b), (la, _) = _both(spark, pdf, "Date string, Revenue double, seq long", on_bad_dates="null")
    assert len(a) == len(b) == 0 and any("Removed 5 rows" in m for m in la["msg"])


def test_panel_in_chunks(spark, sf_small):
    raw = fx.dirty_daily_by_brand(spark, sf_small)
    a, la = clean_sales(raw, ["series_key"], seq="seq")
    b, lb = clean_sales(raw, ["series_key"], seq="seq", chunk_rows=32)
    cols = ["series_key", "seq"]
    pd.testing.assert_frame_equal(a.orderBy(*cols).toPandas(), b.orderBy(*cols).toPandas())
    pd.testing.assert_frame_equal(la.orderBy("seq").toPandas(), lb.orderBy("seq").toPandas())


def test_null_series_and_a_hot_price(spark):
    """A null key is a series of its own; half of one series shares a price."""
    rows = [(None if i % 3 == 0 else "A", i, f"2024-01-{1 + i % 28:02d}", 99999.0 if i == 33 else 50.0 + i % 7,
             None if i % 5 == 0 else 7.0, 2.0 if i % 2 else 1.0 + i) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, seq long, Date string, Revenue double, Units double, Price double")
    got = clean_sales(df, ["k"], seq="seq", chunk_rows=16)[0].toPandas()
    for k, part in df.toPandas().fillna({"k": "~"}).groupby("k"):
        part = part.sort_values("seq")
        own = got[got["k"].fillna("~") == k].sort_values("seq")
        q1, q3 = part["Revenue"].quantile([0.25, 0.75])
        np.testing.assert_allclose(own["revenue"], part["Revenue"].clip(max(0, q1 - 3 * (q3 - q1)), q3 + 3 * (q3 - q1)))
        np.testing.assert_array_equal(own["units_sold"], part["Units"].ffill().fillna(part["Units"].median()))


def test_no_task_holds_a_series(spark, sf_small):
    """No window of the plan is dealt by the series alone, but for the table of chunks."""
    raw = fx.dirty_daily_by_brand(spark, sf_small)
    clean, _ = clean_sales(raw, ["series_key"], seq="seq")
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_wide_gaps_make_no_small_chunks(spark):
    """The table of chunks stays small when the order column has gaps wider than a chunk."""
    rows = [("A", i * 10_000_000_000, float(i) if i % 7 == 0 else None) for i in range(1000)] + [("B", None, 1.0), ("B", 5, None), ("B", 5, None)]
    df = spark.createDataFrame(rows, "k string, s long, v double").repartition(3)
    placed = C.local(df.withColumn(C.KEY, C.series_key(["k"])), ["v"], "s", 16)
    assert C.carried(placed, ["v"]).count() < 100
    filled = C.forward_fill(df, ["v"], ["k"], "s", 16).where("k = 'A'").orderBy("s").collect()
    assert [(r["s"], r["v"]) for r in filled] == [(i * 10_000_000_000, float(i - i % 7)) for i in range(1000)]
    numbers = {r["s"]: r["_rn"] for r in C.row_numbers(df.where("k = 'A'"), ["k"], "s", 16).collect()}
    assert numbers == {i * 10_000_000_000: i + 1 for i in range(1000)}
    # Rows without a place come first, carry on, and go.
    assert [r["v"] for r in C.forward_fill(df, ["v"], ["k"], "s", 16).where("k = 'B'").collect()] == [1.0, 1.0]
