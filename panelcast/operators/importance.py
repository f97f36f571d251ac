"""I-01…I-11: feature attribution for a fitted model, as Spark jobs.

Permutation importance scores rows × features × repeats in one
``transform``. A repeat permutes the rows by a cyclic shift over their hash
order; positions in it are dense numbers from per-chunk counts and their
prefix sums, so each row meets its donor in one equi-join, no task holds the
whole training set, and the permutation is the same at every size and
partitioning. The features are fanned out only after that join. Sampled
Shapley values draw their background rows in the same way from the whole
training split. Linear attribution is one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.session import ensure_checkpoint_dir

# Heuristic weights (percent) used for the smoothing model.
TS_HEURISTIC = [
    ("lag_1", 30.0), ("rolling_mean_3", 22.0), ("lag_2", 15.0), ("month_sin", 12.0),
    ("month_cos", 8.0), ("units_sold", 7.0), ("price", 4.0), ("lag_3", 2.0),
]
# Display names of the features.
FRIENDLY_NAMES = {
    "lag_1": "Lag Revenue (1mo)",
    "lag_2": "Lag Revenue (2mo)",
    "lag_3": "Lag Revenue (3mo)",
    "rolling_mean_3": "Rolling Avg (3mo)",
    "rolling_mean_6": "Rolling Avg (6mo)",
    "rolling_std_3": "Revenue Volatility",
    "month_sin": "Seasonality (sin)",
    "month_cos": "Seasonality (cos)",
    "month": "Month",
    "quarter": "Quarter",
    "year": "Year",
    "day_of_year": "Day of Year",
    "units_sold": "Units Sold",
    "price": "Price",
}
PERMUTATION_REPEATS = 10
SEED = 42
#: Chunks of the hash order (a power of two): a chunk is one window partition.
CHUNKS = 4096
TOP_K = 10

METHOD_PERMUTATION = "Permutation importance"
METHOD_LINEAR = "Linear attribution"
METHOD_HEURISTIC = "Time-series heuristic"
METHOD_UNIFORM = "Uniform (fallback)"


def friendly(col: Column) -> Column:
    """I-09: display name, or the name itself when unknown."""
    m = F.create_map(*[F.lit(x) for kv in FRIENDLY_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col), col)


def heuristic_importance(spark: SparkSession, feature_cols: Sequence[str]) -> DataFrame:
    """I-01: fixed weights for the features present, largest first."""
    rows = [(f, w) for f, w in TS_HEURISTIC if f in set(feature_cols)] or list(TS_HEURISTIC)
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.select(friendly(F.col("feature")).alias("feature"), "importance",
                     F.lit(METHOD_HEURISTIC).alias("method"))


def uniform_importance(spark: SparkSession, feature_cols: Sequence[str]) -> DataFrame:
    """I-07: 1/d each."""
    d = len(feature_cols)
    return spark.createDataFrame([(f, 1.0 / d) for f in feature_cols],
                                 "feature string, importance double") \
        .withColumn("method", F.lit(METHOD_UNIFORM))


def _r2(actual: Column, predicted: Column, mean: Column) -> Column:
    sse, sst = F.sum((actual - predicted) ** 2), F.sum((actual - mean) ** 2)
    return 1 - F.try_divide(sse, sst)


def donors(rows: DataFrame, repeats: int, seed: int, chunks: int = CHUNKS) -> DataFrame:
    """``rows(_rid, _x, …)`` once per repeat ``_r``, with the vector ``_d`` of another row.

    In repeat r the rows are ordered by a hash of (_rid, r, seed); a row's donor is
    the one before it, the first row's is the last.
    """
    h = F.xxhash64("_rid", "_r", F.lit(seed))
    x = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_r")).withColumns({
        "_h": h, "_chunk": F.pmod(F.shiftright(h, 40), F.lit(chunks))})
    counts = x.groupBy("_r", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    family = Window.partitionBy("_r")
    before = family.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_r", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                            F.sum("_n").over(family).alias("_all"))
    local = F.row_number().over(Window.partitionBy("_r", "_chunk").orderBy("_h", "_rid")) - 1
    placed = x.withColumn("_pos", local).join(offsets, ["_r", "_chunk"]).withColumn("_pos", F.col("_pos") + F.col("_off"))
    giving = placed.select(F.col("_r").alias("_gr"), F.col("_x").alias("_d"),
                           F.pmod(F.col("_pos") + 1, F.col("_all")).alias("_gpos"))
    joined = placed.join(giving, (F.col("_r") == F.col("_gr")) & (F.col("_pos") == F.col("_gpos")))
    return joined.drop("_h", "_chunk", "_off", "_all", "_pos", "_gr", "_gpos")


def _rows(data: DataFrame, id_cols: Sequence[str], *more: Column) -> DataFrame:
    return data.select(F.struct(*[F.col(c) for c in id_cols]).alias("_rid"), vector_to_array("features").alias("_x"), *more)


def permutation_importance(model, data: DataFrame, feature_cols: Sequence[str],
                           label: str = "revenue", repeats: int = PERMUTATION_REPEATS,
                           seed: int = SEED, id_cols: Sequence[str] = ("date",)) -> DataFrame:
    """I-06: |mean R² drop| per feature when that feature is shuffled.

    ``data`` holds the assembled ``features`` vector, ``label`` and
    ``id_cols`` that identify a row. It is written once to the shared
    checkpoint folder, as three jobs read it.
    """
    d = len(feature_cols)
    ensure_checkpoint_dir(data.sparkSession)
    base = _rows(data, id_cols, F.col(label).alias("_y")).checkpoint(eager=True)
    ybar = base.agg(F.avg("_y")).first()[0]
    scored = model.transform(base.withColumn("features", array_to_vector("_x")))
    base_r2 = scored.agg(_r2(F.col("_y"), F.col("prediction"), F.lit(ybar).cast("double"))).first()[0]
    x = donors(base, repeats, seed).select("*", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("_j"))
    shuffled = F.transform("_x", lambda v, i: F.when(i == F.col("_j"), F.element_at("_d", i + 1)).otherwise(v))
    scored = model.transform(x.withColumn("features", array_to_vector(shuffled)))
    per_rep = scored.groupBy("_j", "_r").agg(
        _r2(F.col("_y"), F.col("prediction"), F.lit(ybar).cast("double")).alias("r2"))
    names = F.array(*[F.lit(c) for c in feature_cols])
    return per_rep.groupBy("_j").agg(F.avg(F.lit(base_r2) - F.col("r2")).alias("drop")).select(
        F.element_at(names, F.col("_j") + 1).alias("feature"),
        F.abs("drop").alias("importance"), F.lit(METHOD_PERMUTATION).alias("method"))


def linear_rows(coefficients: Sequence[float], data: DataFrame, feature_cols: Sequence[str],
                id_cols: Sequence[str] = ("date",)) -> DataFrame:
    """I-10 of a linear model: (id_cols…, feature, shap) with βⱼ·(xⱼ − x̄ⱼ) for every row."""
    x = vector_to_array("features")
    m = data.agg(*[F.avg(F.element_at(x, j + 1)).alias(f"m{j}") for j in range(len(feature_cols))]).first()
    parts = [F.struct(F.lit(c).alias("feature"), (F.lit(float(b)) * (F.element_at("_x", j + 1) - F.lit(float(m[j])))).alias("shap"))
             for j, (c, b) in enumerate(zip(feature_cols, coefficients))] if m[0] is not None else []
    if not parts:
        return data.select(*id_cols, F.lit("").alias("feature"), F.lit(0.0).alias("shap")).limit(0)
    return data.select(*id_cols, x.alias("_x")).select(*id_cols, F.inline(F.array(*parts)))


def linear_attribution(coefficients: Sequence[float], data: DataFrame,
                       feature_cols: Sequence[str]) -> DataFrame:
    """I-04: mean |βⱼ·(xⱼ − x̄ⱼ)| — exact Shapley values of a linear model
    with independent features — in one aggregate, then long form."""
    x = vector_to_array("features")
    means = [F.avg(F.element_at(x, j + 1)) for j in range(len(feature_cols))]
    m = data.agg(*[mu.alias(f"m{j}") for j, mu in enumerate(means)]).first()
    aggs = [F.avg(F.abs(F.lit(float(b)) * (F.element_at(x, j + 1) - F.lit(float(m[j])))))
            .alias(f"a{j}") for j, b in enumerate(coefficients)]
    wide = data.agg(*aggs)
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"a{j}").alias("importance"))
               for j, c in enumerate(feature_cols)]
    return wide.select(F.inline(F.array(*entries))).withColumn("method", F.lit(METHOD_LINEAR))


def normalise(raw: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """I-08, I-09: percent of the total (zero total → 1), 2 dp, >0, largest first, top k.

    ``raw`` has at most one row per feature, so the global window is small.
    """
    total = F.sum("importance").over(Window.partitionBy())
    pct = F.bround(F.col("importance") / F.when(total == 0, F.lit(1.0)).otherwise(total) * 100, 2)
    ranked = raw.withColumn("importance", pct).filter(F.col("importance") > 0)
    w = Window.orderBy(F.col("importance").desc(), "feature")
    return (ranked.withColumn("rank", F.row_number().over(w).cast("int"))
            .filter(F.col("rank") <= top_k)
            .withColumn("feature", friendly(F.col("feature"))))


def top_drivers(importance: DataFrame, k: int = 3) -> DataFrame:
    """I-11: the first k drivers (3 on the summary page, 8 in the report)."""
    return importance.filter(F.col("rank") <= k)


METHOD_SHAPLEY = "Shapley sampling"
SHAPLEY_SAMPLES = 50


def shapley_sampling(model, data: DataFrame, feature_cols: Sequence[str],
                     id_cols: Sequence[str] = ("date",), samples: int = SHAPLEY_SAMPLES,
                     seed: int = SEED) -> DataFrame:
    """I-02/I-03/I-05/I-10: per-row Shapley values by permutation sampling.

    For each row, ``samples`` pairs (background row, feature order) are
    drawn: the background is another row of ``data`` (``donors``), the order
    follows a seeded hash. Along an order the row's values replace the
    background's one feature at a time, the model scores the d+1 mixed vectors
    and the successive differences are the features' contributions
    (Štrumbelj & Kononenko, 2014). The vector after k replacements adds its
    prediction to the k-th feature and takes it from the (k+1)-th, so a
    map-side combined sum per (row, feature) replaces a window over the steps.

    Returns ``(id_cols…, feature, shap)``; contributions of a row add up to
    its prediction minus the mean prediction over its sampled backgrounds.
    """
    d = len(feature_cols)
    ensure_checkpoint_dir(data.sparkSession)
    base = _rows(data, id_cols).checkpoint(eager=True)
    order = F.transform(F.array_sort(F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda j: F.struct(F.xxhash64("_rid", "_r", j, F.lit(seed + 7)).alias("h"), j.alias("j")))), lambda t: t["j"])
    k = donors(base, samples, seed).withColumn("_order", order).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_k"))
    # Feature j comes from the row when it is among the first k of the order.
    mixed = F.transform("_x", lambda v, j: F.when(
        F.array_position("_order", j) <= F.col("_k"), v).otherwise(F.element_at("_d", j + 1)))
    scored = model.transform(k.withColumn("features", array_to_vector(mixed)))
    gives = F.filter(F.array(F.struct(F.get("_order", F.col("_k") - 1).alias("j"), F.col("prediction").alias("v")),
                             F.struct(F.get("_order", F.col("_k")).alias("j"), (-F.col("prediction")).alias("v"))),
                     lambda g: g["j"].isNotNull())
    names = F.array(*[F.lit(c) for c in feature_cols])
    return (scored.select("_rid", F.inline(gives)).groupBy("_rid", "j").agg((F.sum("v") / samples).alias("shap"))
            .select("_rid.*", F.element_at(names, F.col("j") + 1).alias("feature"), "shap"))


def shapley_importance(attributions: DataFrame) -> DataFrame:
    """I-03 → mean |Shapley value| per feature (then ``normalise``)."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("shap")).alias("importance")) \
        .withColumn("method", F.lit(METHOD_SHAPLEY))
