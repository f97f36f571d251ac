"""A-02: seeded synthetic monthly sales, generated on the executors.

The reference draws one series with numpy; ours draws ``n_series`` series
with Spark's seeded ``rand``/``randn`` (values differ from numpy's, the
shape and formulas are the same). ``noise=False`` gives a deterministic
variant that an SQL oracle can reproduce.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Generator constants.
START = "2022-01-01"
STEP_DAYS = 30
BASE_PRICE = 48.0
BASE_UNITS = 1600
SEASON_AMPLITUDE = 0.35
TREND_PER_PERIOD = 0.012
NOISE_LOW, NOISE_SPAN = 0.92, 0.16
PRICE_SD = 2.5


def synthetic_sales(spark: SparkSession, n_series: int = 1, n_periods: int = 36, seed: int = 42,
                    noise: bool = True) -> DataFrame:
    """Raw-shaped table ``(series_key, Date, Revenue, Units_Sold, Price)`` (Date as text)."""
    ids = spark.range(n_series * n_periods)
    i = (F.col("id") % n_periods).cast("int")
    s = (F.col("id") / n_periods).cast("long")
    d = F.date_add(F.lit(START).cast("date"), i * STEP_DAYS)
    seasonal = 1 + SEASON_AMPLITUDE * F.sin((F.month(d) - 3) * math.pi / 6)
    trend = 1 + i * TREND_PER_PERIOD
    jitter = (NOISE_LOW + F.rand(seed) * NOISE_SPAN) if noise else F.lit(NOISE_LOW + NOISE_SPAN / 2)
    price = F.round(BASE_PRICE + F.randn(seed + 1) * PRICE_SD, 2) if noise else F.lit(BASE_PRICE)
    units = F.floor(BASE_UNITS * seasonal * trend * jitter).cast("long")
    out = ids.select(F.format_string("S%05d", s).alias("series_key"),
                     F.date_format(d, "yyyy-MM-dd").alias("Date"),
                     price.alias("Price"), units.alias("Units_Sold"), F.col("id").alias("seq"))
    return out.select("series_key", "Date",
                      F.round(F.col("Price") * F.col("Units_Sold"), 2).alias("Revenue"),
                      "Units_Sold", "Price", "seq")
