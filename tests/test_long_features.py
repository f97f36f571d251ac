"""Features over blocks with halos equal those over whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators.features import add_features
from panelcast.operators.long_features import add_long_features, positions
from panelcast.operators.chunked import KEY, series_key


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, n in [("long", 150), ("six", 6), ("one", 1), ("two", 2), (None, 40), ("poor", 20), ("zero", 30), ("thin", 33)]:
        for i in range(n):
            revenue = 0.0 if k == "zero" and i % 3 else float(rng.integers(0, 40))
            price = None if k == "poor" or (k == "thin" and i < 31) or rng.random() < 0.3 else float(rng.integers(1, 9))
            rows.append((k, f"2024-01-{1 + i // 7:02d}" if n <= 150 else None, revenue, None if rng.random() < 0.4 else float(i), price, i))
    return spark.createDataFrame(rows, "k string, d string, revenue double, units_sold double, price double, seq long").select(
        "k", F.to_timestamp("d").cast("timestamp_ntz").alias("date"), "revenue", "units_sold", "price", "seq").repartition(5)


@pytest.mark.parametrize("fill", ["bfill", "drop"])
@pytest.mark.parametrize("block", [6, 7, 20, 1 << 16])
def test_same_as_whole_series(spark, panel, fill, block):
    a = add_features(panel, ["k"], fill)
    b = add_long_features(panel, ["k"], fill, block)
    assert a.columns == b.columns and a.dtypes == b.dtypes
    key = lambda r: (r["k"] is not None, r["k"] or "", r["seq"])
    for x, y in zip(sorted(a.collect(), key=key), sorted(b.collect(), key=key), strict=True):
        for c in a.columns:
            assert x[c] == y[c] or (x[c] is not None and y[c] is not None and abs(x[c] - y[c]) <= 1e-9 * max(1, abs(x[c]))), (c, x, y)


def test_one_series_and_no_rows(spark, panel):
    a = add_features(panel.drop("k").where("seq < 40").dropDuplicates(["date", "seq"]), [])
    assert add_long_features(panel.limit(0), ["k"]).collect() == []
    b = add_long_features(panel.drop("k").where("seq < 40").dropDuplicates(["date", "seq"]), [], block_rows=9)
    assert a.count() == b.count() and b.columns == a.columns
    with pytest.raises(ValueError):
        add_long_features(panel, ["k"], block_rows=5)
    with pytest.raises(ValueError):
        add_long_features(panel, ["k"], "pad")


def test_positions_with_ties(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", i // 2) for i in range(30)] + [(None, None)] * 5, "k string, o long")
    got = positions(df.withColumn(KEY, series_key(["k"])), ["o"]).collect()
    for k, n in (("a", 50), ("b", 30), (None, 5)):
        mine = sorted((r["_pos"], r["o"]) for r in got if r["k"] == k)
        assert [p for p, _ in mine] == list(range(n)) and ([o for _, o in mine] == sorted(o for _, o in mine) if k else True)


def test_no_window_by_series_over_rows(spark, panel):
    plan = add_long_features(panel, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
