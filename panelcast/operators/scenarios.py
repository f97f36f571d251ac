"""K-01…K-07: price, volume and marketing scenarios over a forecast.

Scenarios are lever settings ``(scenario_id, price_pct, units_pct,
mkt_pct)``. A grid is an array expression built from its ranges (its size is
fixed by the parameters); saved scenarios are a table keyed by series and
reach the forecast by an equi-join. Totals of a grid are computed per (series,
setting) from the array of the series' few forecast steps, so no row is made
per step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.numbers import filled

# Marketing return on spend, lever ranges and narrative cut-offs.
MARKETING_ROMI = 0.35
PRICE_RANGE = (-50, 50)
UNITS_RANGE = (-50, 50)
MKT_RANGE = (-30, 100)
LEVER_NOTE_CUT = 5
MKT_NOTE_CUT = 20
# Texts of the impact notes; the oracle reads them too.
NOTE_BOTH = "Price %+d%% and volume %+d%% together change revenue by %+.1f%%."
NOTE_MARKETING = "Marketing %+d%% lifts revenue by an estimated %+.1f%%."
NOTE_PRICE = "Price %+d%% changes revenue by %+.1f%% if demand holds."
NOTE_PLAIN = "Change against the forecast: %+.1f%%."


def multiplier(p: Column, u: Column, m: Column) -> Column:
    """K-01: (1+p/100)(1+u/100)(1+0.35·m/100)."""
    return (1 + p / 100.0) * (1 + u / 100.0) * (1 + m / 100.0 * MARKETING_ROMI)


def lever_grid(price_step: int = 1, units_step: int = 1, mkt_step: int = 5,
               price=PRICE_RANGE, units=UNITS_RANGE, mkt=MKT_RANGE) -> Column:
    """All lever settings on a grid, each lever with its own step, as an array<struct> expression."""
    def seq(r, step):
        return F.sequence(F.lit(r[0]), F.lit(r[1]), F.lit(step))
    grid = F.flatten(F.transform(seq(price, price_step), lambda p: F.flatten(F.transform(
        seq(units, units_step), lambda u: F.transform(
            seq(mkt, mkt_step), lambda m: F.struct(p.alias("price_pct"), u.alias("units_pct"),
                                         m.alias("mkt_pct")))))))
    return F.transform(grid, lambda s, i: F.struct(
        (i + 1).alias("scenario_id"), s["price_pct"].alias("price_pct"),
        s["units_pct"].alias("units_pct"), s["mkt_pct"].alias("mkt_pct")))


def simulate(forecast: DataFrame, grid: Column, keys: Sequence[str] = ()) -> DataFrame:
    """K-01, K-02, K-04: per-(series, scenario, step) revenue and flag."""
    keys = list(keys)
    x = forecast.select(*keys, "step", "date", F.col("forecast").alias("base"),
                        F.explode(grid).alias("_set"))
    return _revenue(x.select(*keys, "_set.*", "step", "date", "base"))


def simulate_saved(forecast: DataFrame, scenarios: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """K-06: the same for a table of saved settings ``(keys…, scenario_id, price_pct, units_pct, mkt_pct)``.

    Each series meets its own settings in an equi-join (null keys match); without
    keys, every setting belongs to the one series."""
    keys = list(keys)
    levers = ["scenario_id", "price_pct", "units_pct", "mkt_pct"]
    f, s = forecast.withColumn("_one", F.lit(1)).alias("f"), scenarios.withColumn("_one", F.lit(1)).alias("s")
    same = F.lit(True)
    for k in keys or ["_one"]:
        same = same & F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}"))
    return _revenue(f.join(s, same).select(*[f"f.{k}" for k in keys], *[f"s.{c}" for c in levers], "f.step", "f.date",
                                           F.col("f.forecast").alias("base")))


def _revenue(x: DataFrame) -> DataFrame:
    mult = multiplier(F.col("price_pct"), F.col("units_pct"), F.col("mkt_pct"))
    rev = F.rint(F.col("base") * mult).cast("bigint")
    return x.withColumns({"scenario": rev}).withColumns({
        "diff": F.col("scenario").cast("double") - F.col("base"),
        "better": F.col("scenario") >= F.col("base")})


def impacts(forecast: DataFrame, grid: Column, keys: Sequence[str] = ()) -> DataFrame:
    """K-03, K-05 of a whole grid: a series' steps become an array, then one row per setting."""
    keys = list(keys)
    x = _bases(forecast, keys).select("*", F.explode(grid).alias("_set"))
    m = multiplier(F.col("_set.price_pct"), F.col("_set.units_pct"), F.col("_set.mkt_pct"))
    total = F.aggregate("bases", F.lit(0).cast("long"), lambda acc, b: acc + F.rint(b * m).cast("long"))
    return noted(x.select(*keys, "_set.*", "base_total", total.alias("scenario_total"))
                  .withColumn("impact", F.col("scenario_total").cast("double") - F.col("base_total")))


def best_of(forecast: DataFrame, grid: Column, keys: Sequence[str] = ()) -> DataFrame:
    """K-07 of a whole grid: a map-side combined maximum, whatever the grid's size (ties → lowest id).

    No step of a forecast that is nowhere negative loses by a larger multiplier, so the largest
    one has the best total, and a setting can tie with it only if its multiplier keeps
    every step's rounded value. Settings below that bound aren't totalled; a series with a
    negative step has all of its settings totalled.
    """
    keys = list(keys)
    m = multiplier(F.col("_set.price_pct"), F.col("_set.units_pct"), F.col("_set.mkt_pct"))
    top = forecast.sparkSession.range(1).select(F.explode(grid).alias("_set")).agg(F.max(m)).first()[0]
    # A little below the exact bound, as the division rounds.
    least = F.array_max(F.transform("bases", lambda b: F.when(b > 0, (F.rint(b * top) - 0.5) / b * (1 - 1e-9))))
    some_negative = F.exists("bases", lambda b: b < 0)
    x = _bases(forecast, keys).withColumn("_least", F.when(~some_negative, least)).select("*", F.explode(grid).alias("_set"))
    x = x.where(F.coalesce(m >= F.col("_least"), F.lit(True)))
    total = F.aggregate("bases", F.lit(0).cast("long"), lambda acc, b: acc + F.rint(b * m).cast("long"))
    best = F.max(F.struct(F.col("total"), (-F.col("_set.scenario_id")).alias("_o"), F.col("_set")))
    top = x.select(*keys, "base_total", "_set", total.alias("total")).groupBy(*keys, "base_total").agg(best.alias("_best"))
    return noted(top.select(*keys, "_best._set.*", "base_total", F.col("_best.total").alias("scenario_total"))
                  .withColumn("impact", F.col("scenario_total").cast("double") - F.col("base_total")))


def _bases(forecast: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series: its forecast steps (as many as the horizon) and their sum."""
    return forecast.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "forecast"))), lambda s: s["forecast"]).alias("bases"),
        F.sum("forecast").alias("base_total"))


def impact(detail: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """K-03, K-05: totals, impact % and the narrative per (series, scenario)."""
    keys = list(keys)
    a = detail.groupBy(*keys, "scenario_id", "price_pct", "units_pct", "mkt_pct").agg(
        F.sum("base").alias("base_total"),
        F.sum("scenario").alias("scenario_total"),
        F.sum("diff").alias("impact"))
    return noted(a)


def noted(a: DataFrame) -> DataFrame:
    """K-05: impact %, note and its type for rows with base_total, impact and the three levers."""
    a = a.withColumn("impact_pct", F.try_divide(F.col("impact"), F.col("base_total")) * 100)
    p, u, m, pct = F.col("price_pct"), F.col("units_pct"), F.col("mkt_pct"), F.col("impact_pct")
    text = (F.when((F.abs(p) > LEVER_NOTE_CUT) & (F.abs(u) > LEVER_NOTE_CUT), filled(NOTE_BOTH, p, u, pct))
            .when(m > MKT_NOTE_CUT, filled(NOTE_MARKETING, m, pct))
            .when(F.abs(p) > LEVER_NOTE_CUT, filled(NOTE_PRICE, p, pct))
            .otherwise(filled(NOTE_PLAIN, pct)))
    return a.withColumns({"note": text,
                          "note_type": F.when(F.col("impact") >= 0, "success").otherwise("danger")})


def best_scenario(impacts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """K-07: highest-impact scenario per series (ties → lowest id)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col("impact").desc(), "scenario_id")
    return impacts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def save_scenarios(impacts: DataFrame, path: str) -> None:
    """K-06: append scenario results to a table (parquet) in the shared store."""
    impacts.write.mode("append").parquet(path)


def list_scenarios(spark, path: str) -> DataFrame:
    """K-06: the saved scenarios, in saving order per series."""
    return spark.read.parquet(path)
