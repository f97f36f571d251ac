"""Importance, insights, reports, activity log and the stream variant."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import importance as I
from panelcast.operators import report as H
from panelcast.operators.activity import activity_counts, activity_footer, activity_view
from panelcast.operators.features import add_features
from panelcast.operators import insights as J
from panelcast.operators.insights import insights
from panelcast.operators.models import LINEAR
from panelcast.operators.training import assemble, train_models
from panelcast.sources import fixtures as fx
from panelcast.sources.activity_log import append_activity, read_activity_log
from panelcast.sources.sinks import TITLE, report_lines, write_report


@pytest.fixture(scope="module")
def trained(spark, sf_small):
    feats = add_features(fx.sales_by_brand(spark, sf_small), ["series_key"])
    tr = train_models(feats, ["series_key"], models=[LINEAR], cv=False)
    return feats, tr


def test_linear_attribution_formula(spark, trained):
    feats, tr = trained
    data = assemble(feats, ["series_key"], tr.feature_cols).filter(~F.col("is_test"))
    coef = tr.fitted[LINEAR].coefficients.toArray()
    got = {r["feature"]: r["importance"] for r in
           I.linear_attribution(coef.tolist(), data, tr.feature_cols).collect()}
    x = np.array([r["features"].toArray() for r in data.select("features").collect()])
    want = np.abs(coef * (x - x.mean(axis=0))).mean(axis=0)
    for j, c in enumerate(tr.feature_cols):
        assert got[c] == pytest.approx(want[j], rel=1e-9, abs=1e-9)


def test_permutation_importance_and_normalise(spark, trained):
    feats, tr = trained
    data = assemble(feats, ["series_key"], tr.feature_cols).filter(~F.col("is_test"))
    raw = I.permutation_importance(tr.fitted[LINEAR], data, tr.feature_cols, repeats=2,
                                   id_cols=["series_key", "date"])
    assert raw.count() == len(tr.feature_cols)
    norm = I.normalise(raw).toPandas()
    assert len(norm) <= 10 and (norm["importance"] > 0).all()
    assert list(norm["rank"]) == sorted(norm["rank"])
    total = I.normalise(raw, top_k=99).toPandas()["importance"].sum()
    assert total == pytest.approx(100.0, abs=0.1)


def test_heuristic_and_names(spark):
    h = I.heuristic_importance(spark, ["lag_1", "price", "month"]).toPandas()
    assert h["feature"].tolist() == ["Lag Revenue (1mo)", "Price"]
    assert h["importance"].tolist() == [30.0, 4.0]


def test_insights_rules(spark, trained):
    feats, tr = trained
    imp = spark.createDataFrame([("Price", 20.0, 1), ("Seasonality (sin)", 15.0, 2),
                                 ("Lag Revenue (1mo)", 5.0, 3)],
                                "feature string, importance double, rank int") \
        .withColumn("method", F.lit("Permutation importance"))
    got = insights(imp, tr.metrics.filter("is_best"), feats).orderBy("seq").toPandas()
    texts = " ".join(got["text"])
    assert J.T_FIRST % ("Price", 20.0) in texts and J.T_SEASON % 15.0 in texts
    assert got.loc[got["text"].str.startswith("Price holds"), "type"].iloc[0] == "danger"
    empty = imp.limit(0)
    e = insights(empty, tr.metrics.filter("is_best"), feats).toPandas()
    assert e["text"].tolist() == [J.T_NONE]


def test_report_sections_and_sinks(spark, sf_small, trained):
    feats, tr = trained
    panel = fx.sales_by_brand(spark, sf_small)
    summary = H.summary_section(panel, ["series_key"])
    assert summary.filter("label = 'Total Revenue'").first()["value"].startswith("$")
    out = tempfile.mkdtemp(prefix="panelcast-report-")
    written = write_report(out, {"summary": summary, "models": H.model_section(tr.metrics),
                                 "cleaned": panel, "forecast": None})
    assert written == ["summary", "models", "cleaned"]
    back = spark.read.option("header", True).csv(os.path.join(out, "cleaned"))
    assert back.count() == panel.count()
    lines = report_lines({"models": H.model_section(tr.metrics), "forecast": None}) \
        .orderBy("section_no", "line_no").toPandas()
    assert lines["text"].iloc[0] == TITLE
    assert lines["text"].iloc[1] == "--- MODEL EVALUATION ---"


def test_activity_log_roundtrip_and_filters(spark, sf_small):
    path = os.path.join(tempfile.mkdtemp(prefix="panelcast-log-"), "log")
    assert read_activity_log(spark, path).count() == 0           # missing file → empty
    ev = fx.activity_events(spark, sf_small).withColumn(
        "action", F.when(F.col("action") == "view", "Login").when(F.col("action") == "click", "Logout")
        .when(F.col("action") == "signup", "Registered").otherwise(F.col("action")))
    append_activity(ev, path)
    log = read_activity_log(spark, path)
    assert log.count() == ev.count()
    c = activity_counts(log).first()
    assert c["total_events"] == ev.count()
    assert c["n_login"] == ev.filter("action = 'Login'").count()
    v = activity_view(log, action="Login", role="admin")
    assert v.count() == ev.filter("action = 'Login' AND role = 'admin'").count()
    f = activity_footer(log, action="Logout").first()
    assert f["footer"] == f"Showing {f['shown']} of {f['total']} events"


def test_activity_stream_counts(spark, sf_small):
    from panelcast.streaming.activity import read_log_stream, windowed_counts
    src = os.path.join(tempfile.mkdtemp(prefix="panelcast-stream-"), "in")
    append_activity(fx.activity_events(spark, sf_small).withColumn("action", F.lit("Login")), src)
    out = os.path.join(os.path.dirname(src), "out")
    q = (windowed_counts(read_log_stream(spark, src), window="1 day", watermark="0 seconds")
         .writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(os.path.dirname(src), "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    total = fx.activity_events(spark, sf_small).count()
    # Windows still open at the watermark are not emitted in append mode.
    assert 0 < got.agg(F.sum("total_events")).first()[0] <= total


def test_donors_are_one_cycle_at_any_partitioning(spark):
    rows = spark.range(500).select(F.struct("id").alias("_rid"), F.array(F.col("id").cast("double")).alias("_x"))
    got = [sorted((r._r, r._rid.id, int(r._d[0])) for r in I.donors(rows.repartition(n), 3, 42, chunks=c).collect())
           for n, c in ((1, 16), (7, 16), (3, 4))]
    assert got[0] == got[1] and len(got[0]) == len(got[2]) == 1500
    for rep in range(3):
        step = {a: b for r, a, b in got[0] if r == rep}
        at, seen = 0, []
        while at not in seen:
            seen.append(at)
            at = step[at]
        assert len(seen) == 500


def test_shapley_sampling_of_a_linear_model(spark, trained):
    feats, tr = trained
    data = assemble(feats, ["series_key"], tr.feature_cols).filter(~F.col("is_test")).orderBy("series_key", "date").limit(7)
    model = tr.fitted[LINEAR]
    att = I.shapley_sampling(model, data, tr.feature_cols, id_cols=["series_key", "date"], samples=3).toPandas()
    coef = model.coefficients.toArray()
    base = data.select(F.struct("series_key", "date").alias("_rid"), I.vector_to_array("features").alias("_x"))
    want = {}
    for r in I.donors(base, 3, 42).collect():
        for j, c in enumerate(tr.feature_cols):
            k = (r._rid.series_key, str(r._rid.date), c)
            want[k] = want.get(k, 0) + coef[j] * (r._x[j] - r._d[j]) / 3
    assert len(att) == 7 * len(tr.feature_cols)
    for _, r in att.iterrows():
        w = want[r["series_key"], str(r["date"]), r["feature"]]
        assert r["shap"] == pytest.approx(w, rel=1e-6, abs=1e-6 * max(1.0, abs(w)))
    imp = I.normalise(I.shapley_importance(spark.createDataFrame(att)), top_k=99).toPandas()
    assert imp["importance"].sum() == pytest.approx(100.0, abs=0.1)


def test_uniform_weights_if_the_model_cannot_score(spark, trained):
    from pyspark.ml.feature import SQLTransformer

    from panelcast.plans import analysis
    feats, tr = trained
    broken = SQLTransformer(statement="SELECT *, raise_error('no') AS prediction FROM __THIS__")
    tr = type(tr)(metrics=tr.metrics, predictions=tr.predictions, fitted={"Broken": broken}, feature_cols=tr.feature_cols)
    with pytest.warns(UserWarning):
        imp = analysis.best_importance(feats, tr, ["series_key"], model="Broken").toPandas()
    assert set(imp["method"]) == {I.METHOD_UNIFORM} and imp["importance"].nunique() == 1


def test_log_as_an_indented_array(spark, tmp_path):
    import json
    rows = [{"timestamp": "05 Jan 2024  10:00:00", "username": f"u{i}", "name": "n", "action": None if i == 1 else "Login", "role": "admin"} for i in range(3)]
    (tmp_path / "log.json").write_text(json.dumps(rows, indent=2))
    log = read_activity_log(spark, str(tmp_path / "log.json"))
    assert log.count() == 3
    assert [r.username for r in activity_view(log).collect()] == ["u2", "u1", "u0"]
    (tmp_path / "lines.json").write_text(json.dumps(rows[0]) + "\nnot json\n" + json.dumps(rows[1]) + "\n")
    assert [r.username for r in read_activity_log(spark, str(tmp_path / "lines.json")).orderBy("pos").collect()] == ["u0", "u1"]


def test_log_of_several_layouts(spark, tmp_path):
    """An array, lines appended behind it in the same file, and appended files, all in order."""
    import json
    def entry(i):
        return {"timestamp": "05 Jan 2024  10:00:00", "username": f"u{i}", "name": 'a "{b}" c', "action": "Login", "role": "admin"}
    path = tmp_path / "log"
    path.mkdir()
    (path / "activity_log.json").write_text(json.dumps([entry(i) for i in range(4)], indent=2) + "\n" + json.dumps(entry(4)) + "\nbroken {\n")
    os.utime(path / "activity_log.json", (1_600_000_000, 1_600_000_000))
    for i in (5, 8):
        rows = [(e["timestamp"], e["username"], e["name"], e["action"], e["role"]) for e in map(entry, range(i, i + 3))]
        append_activity(spark.createDataFrame(rows, "timestamp string, username string, name string, action string, role string").repartitionByRange(3, "username"), str(path))
    (path / "other.json").write_text("[" + json.dumps(entry(11)) + "]")
    log = read_activity_log(spark, str(path))
    assert [r.username for r in log.orderBy("pos").collect()] == ["u0", "u1", "u2", "u3", "u4", "u5", "u6", "u7", *["u10", "u8", "u9"], "u11"]
    assert {r.name for r in log.collect()} == {'a "{b}" c'} and log.where("ts IS NULL").count() == 0
    assert [r.username for r in activity_view(log).collect()][0] == "u11"


def test_report_lines_are_ordered_and_escaped(spark):
    df = spark.createDataFrame([(3, 'a "b"'), (1, "x,y"), (2, "l1\nl2")], "step int, note string").repartition(3)
    got = report_lines({"forecast": df}).orderBy("section_no", "line_no").toPandas()["text"].tolist()
    assert report_lines({"forecast": df}).where("section_no = 1").orderBy("line_no").toPandas()["line_no"].tolist() == [0, 1, 2, 3, 4]
    assert got[2:] == ["step,note", '1,"x,y"', '2,"l1\nl2"', '3,"a ""b"""']


def test_save_and_list_scenarios(spark):
    from panelcast.operators.scenarios import list_scenarios, save_scenarios
    path = os.path.join(tempfile.mkdtemp(prefix="panelcast-scen-"), "saved")
    df = spark.createDataFrame([(1, 10, -10, 20, 5.0)],
                               "scenario_id int, price_pct int, units_pct int, mkt_pct int, impact double")
    save_scenarios(df, path)
    save_scenarios(df, path)
    assert list_scenarios(spark, path).count() == 2


def test_start_counts_resumes_from_checkpoint(spark, sf_small):
    import uuid

    from panelcast.streaming.activity import start_counts
    base = tempfile.mkdtemp(prefix="panelcast-stream2-")
    src, out = os.path.join(base, "in"), os.path.join(base, "out")
    ev = fx.activity_events(spark, sf_small).withColumn("action", F.lit("Login"))
    append_activity(ev, src)
    name = f"counts-{uuid.uuid4().hex}"
    q = start_counts(spark, src, out, name=name, available_now=True, window="1 day",
                     watermark="0 seconds")
    q.awaitTermination(120)
    first = spark.read.parquet(out).agg(F.sum("total_events")).first()[0]
    # A second run with no new input resumes from the checkpoint and adds nothing.
    q2 = start_counts(spark, src, out, name=name, available_now=True, window="1 day",
                      watermark="0 seconds")
    q2.awaitTermination(120)
    assert spark.read.parquet(out).agg(F.sum("total_events")).first()[0] == first
