"""G-01, G-03…G-05: recursive forecast with a fitted model, all series at once.

State is one row per series holding the last six values as an
``array<double>``. Each step builds the feature row from that array (lags,
rolling mean/std, calendar, drifted units/price), scores it with the model
and appends the clamped prediction. The horizon is a short driver loop of
lazy stages (H ≤ 12); the state is checkpointed to the shared checkpoint
folder every few steps so lineage stays short and a lost executor only
replays the last steps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.dates import add_periods
from panelcast.operators.common import order_cols
from panelcast.operators.forecast import DEFAULT_HORIZON, Z_BAND, finish
from panelcast.session import ensure_checkpoint_dir

# History length kept, and per-step drift of units and price.
HISTORY = 6
UNITS_DRIFT = 0.005
PRICE_DRIFT = 0.002


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)


def _pop_std(a: Column) -> Column:
    m = _mean(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)) / F.size(a))


def _tail(h: Column, k: int) -> Column:
    return F.slice(h, F.greatest(F.lit(1), F.size(h) - (k - 1)), k)


def step_features(h: Column, date: Column, step: Column | int, units: Column,
                  price: Column) -> dict[str, Column]:
    """G-03, G-04: the model inputs for the next period from the history array."""
    last = F.element_at(h, -1)

    def lag(k: int) -> Column:
        return F.when(F.size(h) >= k, F.element_at(h, -k)).otherwise(last)

    step = F.lit(step) if isinstance(step, int) else step
    month = F.month(date)
    return {
        "month": month, "quarter": F.quarter(date), "year": F.year(date),
        "day_of_year": F.dayofyear(date),
        "month_sin": F.sin(2 * math.pi * month / 12), "month_cos": F.cos(2 * math.pi * month / 12),
        "lag_1": last, "lag_2": lag(2), "lag_3": lag(3),
        "rolling_mean_3": _mean(_tail(h, 3)),
        "rolling_std_3": F.when(F.size(h) >= 3, _pop_std(_tail(h, 3))).otherwise(F.lit(0.0)),
        "rolling_mean_6": _mean(_tail(h, 6)),
        "units_sold": units * (1 + UNITS_DRIFT * step),
        "price": price * (1 + PRICE_DRIFT * step),
    }


def initial_state(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per series: last six revenues (oldest first), last date, units, price.

    Only the last six rows of each series are collected (filtered by a
    window position first), so the array size is fixed whatever the
    series length.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_cols(features)])
    order = [F.col(c) for c in order_cols(features)]
    tail = features.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= HISTORY)
    return tail.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("revenue")))),
                    lambda s: s["revenue"]).alias("h"),
        F.max("date").alias("last_date"),
        F.max_by("units_sold", F.struct(*order)).alias("last_units"),
        F.max_by("price", F.struct(*order)).alias("last_price"),
        F.max_by("revenue", F.struct(*order)).alias("last_actual"))


def recursive_forecast(features: DataFrame, model, feature_cols: Sequence[str],
                       rmse: DataFrame, keys: Sequence[str] = (), horizon: int = DEFAULT_HORIZON,
                       z: float = Z_BAND, checkpoint_every: int = 3, grain: str = "month") -> DataFrame:
    """Forecast ``horizon`` steps per series with a fitted MLlib model.

    ``rmse`` is ``(keys…, rmse)``: the hold-out error that sets each band.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    keys = list(keys)
    ensure_checkpoint_dir(features.sparkSession)
    if keys:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"e.{k}"))
        state = initial_state(features, keys).alias("s").join(rmse.alias("e"), same).select("s.*", "e.rmse")
    else:  # one series: the error is a single number
        state = initial_state(features, keys).withColumn(
            "rmse", F.lit(rmse.select("rmse").first()[0]).cast("double"))
    state = state.withColumn("preds", F.array().cast("array<double>"))
    carry = [*keys, "last_date", "last_units", "last_price", "last_actual", "rmse"]
    assembler = VectorAssembler(inputCols=[f"_x_{c}" for c in feature_cols], outputCol="features")
    for i in range(1, horizon + 1):
        feats = step_features(F.col("h"), add_periods(F.col("last_date"), i, grain), i,
                              F.col("last_units"), F.col("last_price"))
        x = state.withColumns({f"_x_{c}": F.coalesce(feats[c].cast("double"), F.lit(0.0))
                               for c in feature_cols})
        scored = model.transform(assembler.transform(x))
        pred = F.greatest(F.lit(0.0), F.col("prediction"))
        state = scored.select(*carry, _tail(F.concat("h", F.array(pred)), HISTORY).alias("h"),
                              F.concat("preds", F.array(pred)).alias("preds"))
        if checkpoint_every and i % checkpoint_every == 0 and i < horizon:
            state = state.checkpoint(eager=True)
    rows = state.select(*keys, "last_date", "last_actual", "rmse",
                        F.posexplode("preds").alias("pos", "_value"))
    rows = rows.select(*keys, (F.col("pos") + 1).alias("step"),
                       add_periods(F.col("last_date"), F.col("pos") + 1, grain).alias("date"),
                       "_value", F.col("rmse").alias("_rmse"), "last_actual")
    return finish(rows, keys, z)
