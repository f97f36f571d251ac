"""CSV scan → clean, and the nine steps end to end on sf0.001."""

import os
import tempfile

from pyspark.sql import functions as F

from panelcast.operators.clean import clean_sales
from panelcast.operators.models import FOREST, LINEAR
from panelcast.plans import analysis
from panelcast.sources import fixtures as fx
from panelcast.sources.tables import read_sales_file


def test_csv_scan_then_clean(spark, sf_small):
    raw = fx.dirty_daily_by_brand(spark, sf_small)
    path = os.path.join(tempfile.mkdtemp(prefix="panelcast-csv-"), "sales.csv")
    raw.write.option("header", True).csv(path)
    back = read_sales_file(spark, path, fmt="csv")
    assert set(back.columns) == set(raw.columns)
    a, _ = clean_sales(raw, ["series_key"], seq="seq")
    b, _ = clean_sales(back, ["series_key"], seq="seq")
    cols = ["series_key", "seq", "date", "revenue", "units_sold"]
    assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())


def test_analysis_run_fast(spark, sf_small):
    panel = fx.sales_by_brand(spark, sf_small)
    res = analysis.run(panel, ["series_key"], horizon=3, models=[LINEAR, FOREST], trees=10)
    assert res.training.metrics.count() == 3
    assert res.forecast.count() == 3 * panel.select("series_key").distinct().count()
    assert res.forecast.filter(F.col("lower") > F.col("upper")).count() == 0
    assert res.targets.count() > 0 and res.scenarios.count() > 0
    assert res.importance.count() > 0 and res.insights.count() > 0
    assert set(res.sections) == {"summary", "models", "cleaned", "forecast", "importance"}


def test_synthetic_sales_shape_and_cleaning(spark):
    from panelcast.sources.synthetic import synthetic_sales
    raw = synthetic_sales(spark, n_series=3, n_periods=36)
    assert raw.count() == 108
    clean, log = clean_sales(raw, ["series_key"], seq="seq")
    assert clean.count() == 108
    msgs = [r["msg"] for r in log.orderBy("seq").collect()]
    assert msgs[1] == 'Date column "Date" parsed successfully.'
    assert 'Price column: "Price".' in msgs
    det = synthetic_sales(spark, n_series=1, n_periods=12, noise=False).orderBy("seq").toPandas()
    # Deterministic variant: seasonal × trend × mid noise, price fixed at 48.
    import datetime
    import math
    i = 5
    month = (datetime.date(2022, 1, 1) + datetime.timedelta(days=30 * i)).month
    units = int(1600 * (1 + 0.35 * math.sin((month - 3) * math.pi / 6)) * (1 + 0.012 * i) * 1.0)
    assert det["Units_Sold"].iloc[i] == units and det["Price"].iloc[i] == 48.0


def test_smoothing_only_training_and_heuristic_importance(spark, sf_small):
    from panelcast.operators.features import add_features
    from panelcast.operators.smoothing import ES_NAME
    from panelcast.operators.training import train_models
    feats = add_features(fx.sales_by_brand(spark, sf_small), ["series_key"])
    tr = train_models(feats, ["series_key"], models=[])
    assert tr.best_name() == ES_NAME and tr.metrics.count() == 1
    imp = analysis.best_importance(feats, tr, ["series_key"]).toPandas()
    assert imp["feature"].iloc[0] == "Lag Revenue (1mo)"
    assert imp["importance"].sum() == 100.0
    fc = analysis.best_forecast(feats, tr, ["series_key"], horizon=2)
    assert fc.count() == 2 * feats.select("series_key").distinct().count()
