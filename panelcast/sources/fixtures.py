"""Canonical sales panels over the given tables (see FIXTURES.md §2).

Each builder reads whole tables and returns a panel
``(series_key?, date DATE, revenue, units_sold, price)``.
Joins are plain equi-joins: Catalyst broadcasts a side only when its
estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` (and AQE
re-plans from the real shuffle sizes); otherwise it shuffles both sides, with
AQE splitting a skewed key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.rollup import rollup_periods
from panelcast.sources.tables import table

#: Prices and discounts have two decimal places each, event values at most four.
MONEY_SCALE = 4


def net_revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")


def sales_facts_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem(spark, sf_dir)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.col("p_brand").alias("series_key"), F.col("l_shipdate").alias("date"),
                    net_revenue().alias("revenue"), F.col("l_quantity").alias("units_sold")))


def sales_by_brand(spark: SparkSession, sf_dir: str, grain: str = "month") -> DataFrame:
    """Flagship panel: lineitem ⨝ part, monthly net revenue per brand."""
    return rollup_periods(sales_facts_by_brand(spark, sf_dir), ["series_key"], grain=grain, money_scale=MONEY_SCALE)


def sales_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: monthly net revenue over all lineitems."""
    li = _lineitem(spark, sf_dir).select(F.col("l_shipdate").alias("date"),
                                         net_revenue().alias("revenue"),
                                         F.col("l_quantity").alias("units_sold"))
    return rollup_periods(li, [], money_scale=MONEY_SCALE)


def sales_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⨝ orders ⨝ customer ⨝ nation, monthly per customer nation."""
    li = _lineitem(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    facts = (li.join(o, li.l_orderkey == o.o_orderkey)
             .join(c, F.col("o_custkey") == c.c_custkey)
             .join(n, F.col("c_nationkey") == n.n_nationkey)
             .select(F.col("n_name").alias("series_key"), F.col("l_shipdate").alias("date"),
                     net_revenue().alias("revenue"), F.col("l_quantity").alias("units_sold")))
    return rollup_periods(facts, ["series_key"], money_scale=MONEY_SCALE)


def orders_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_key"), F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("revenue"), F.lit(1.0).alias("units_sold"))
    return rollup_periods(o, ["series_key"], money_scale=MONEY_SCALE)


def event_value_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_key"), F.col("ts").alias("date"),
        F.col("value").alias("revenue"), F.lit(1.0).alias("units_sold"))
    return rollup_periods(e, ["series_key"], grain="day", money_scale=MONEY_SCALE)


def dirty_daily_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-shaped sales table with injected faults, for the cleaning operators.

    Daily net revenue per brand is written out the way a user file looks:
    string dates, a text quantity column, no price column, nulls, a ×50
    outlier and negative values, placed by the day number so the oracle
    SQL can mirror them. ``seq`` is the original row position.
    """
    daily = rollup_periods(sales_facts_by_brand(spark, sf_dir), ["series_key"], grain="day", money_scale=MONEY_SCALE)
    day_no = F.datediff(F.col("date"), F.lit("1992-01-01").cast("date"))
    rev = F.col("revenue")
    gross = (F.when(day_no % 17 == 0, F.lit(None).cast("double"))
             .when(day_no % 23 == 0, rev * 50)
             .when(day_no % 31 == 0, -rev)
             .otherwise(rev))
    qty = (F.when(day_no % 29 == 0, F.lit("n/a"))
           .when(day_no % 13 == 0, F.lit(None).cast("string"))
           .otherwise(F.col("units_sold").cast("bigint").cast("string")))
    return daily.select(
        "series_key",
        F.date_format("date", "yyyy-MM-dd").alias("order_day"),
        gross.alias("gross_sales"),
        qty.alias("qty_sold"),
        day_no.cast("bigint").alias("seq"))


def skewed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw order lines as a user file: half of the rows in one series, half of its prices
    one price, missing keys, revenues, units and prices, and a few revenues times 50."""
    li = table(spark, sf_dir, "lineitem")
    c = F.col
    key = (F.when(c("l_orderkey") % 2 == 0, "hot").when(c("l_partkey") % 5 == 0, F.lit(None).cast("string")).otherwise(c("l_returnflag")))
    amount = (F.when(c("l_suppkey") % 11 == 0, F.lit(None).cast("double")).when(c("l_suppkey") % 97 == 1, c("l_extendedprice") * 50)
              .otherwise(c("l_extendedprice")))
    price = (F.when(c("l_partkey") % 7 == 0, F.lit(None).cast("double")).when(c("l_orderkey") % 4 == 0, 99.0)
             .otherwise(c("l_extendedprice") / c("l_quantity")))
    return li.select(key.alias("series_key"), (c("l_orderkey") * 10_000_000_000 + c("l_partkey") * 10_000 + c("l_suppkey") * 10 + c("l_linenumber")).alias("seq"),
                     F.date_format("l_shipdate", "dd-MMM-yyyy").alias("ship_day"), amount.alias("amount"),
                     F.when(c("l_partkey") % 3 != 0, c("l_quantity")).alias("quantity"), price.alias("unit_price"))


#: ``unit_price`` also reads as units, so the roles are named.
SKEWED_ROLES = {"date": "ship_day", "revenue": "amount", "units": "quantity", "price": "unit_price"}


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity log shape over ``events``: action = event_type, role from user_id % 3."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    role = (F.when(F.col("user_id") % 3 == 0, "admin")
            .when(F.col("user_id") % 3 == 1, "analyst").otherwise("viewer"))
    return e.select("event_id", "ts", F.col("user_id").cast("string").alias("username"),
                    F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"),
                    F.col("event_type").alias("action"), role.alias("role"))
