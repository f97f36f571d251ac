"""C-14: roll fact rows up to periods, one row per (series, period)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.common import nan_to_null

GRAINS = ("day", "week", "month", "quarter", "year")


def period_start(date: Column, grain: str) -> Column:
    """Start of the period as a zone-free timestamp (midnight)."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    d = F.to_date(date)
    d = d if grain == "day" else F.trunc(d, grain)
    return d.cast("timestamp_ntz")


def rollup_periods(facts: DataFrame, keys: Sequence[str] = (), *, date: str = "date",
                   revenue: str = "revenue", units: str | None = "units_sold",
                   grain: str = "month", money_scale: int | None = None) -> DataFrame:
    """Sum revenue and units per (keys, period); price = revenue / units.

    A hash aggregate with map-side partial sums: a key that holds a third of
    all fact rows is reduced inside every map task before the shuffle, so the
    shuffle carries at most one row per (task, key, period).

    Amounts are summed as doubles; NaN counts as missing. With ``money_scale``,
    the caller's promise that amounts have at most so many decimal places, they
    are summed as whole numbers of the last place: the total then depends on
    no order of rows. An amount that breaks the promise stops the job.
    """
    keys = list(keys)
    amount = nan_to_null(F.col(revenue).cast("double"))
    if money_scale is None:
        total = F.sum(amount)
    else:
        unit = float(10 ** money_scale)
        whole = F.rint(amount * unit)
        fits = (F.abs(amount * unit - whole) <= 0.01) & (F.abs(whole) < 2.0 ** 53)
        total = F.sum(F.when(fits | amount.isNull(), whole.cast("long")).otherwise(F.raise_error(
            F.format_string("amount %s has more than %d decimal places", amount.cast("string"), F.lit(money_scale))))) / unit
    aggs = [total.alias("revenue")]
    if units:
        aggs.append(F.sum(nan_to_null(F.col(units).cast("double"))).alias("units_sold"))
    out = (facts.groupBy(*keys, period_start(F.col(date), grain).alias("date"))
           .agg(*aggs))
    if units:
        out = out.withColumn("price", F.try_divide(F.col("revenue"), F.col("units_sold")))
    else:
        out = out.withColumn("units_sold", F.lit(None).cast("double")) \
                 .withColumn("price", F.lit(None).cast("double"))
    return out.select(*keys, "date", "revenue", "units_sold", "price")
