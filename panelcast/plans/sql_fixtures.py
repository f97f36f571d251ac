"""DuckDB SQL for the canonical panels, mirrored by ``panelcast.sources.fixtures``.

Used only by the oracle side of the catalog. Each constant is a SELECT that
yields the same columns as the Spark builder of the same name.
"""

def money_sum(expr: str) -> str:
    """Sum of amounts, which have four decimal places at most."""
    return f"CAST(sum(CAST({expr} AS DECIMAL(18, 4))) AS DOUBLE)"


SALES_BY_BRAND = """
SELECT series_key, date, revenue, units_sold, revenue / NULLIF(units_sold, 0) AS price
FROM (
  SELECT p_brand AS series_key, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS date,
         """ + money_sum("l_extendedprice * (1 - l_discount)") + """ AS revenue,
         CAST(sum(l_quantity) AS DOUBLE) AS units_sold
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2)
"""

SALES_TOTAL = """
SELECT date, revenue, units_sold, revenue / NULLIF(units_sold, 0) AS price
FROM (
  SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS date,
         """ + money_sum("l_extendedprice * (1 - l_discount)") + """ AS revenue,
         CAST(sum(l_quantity) AS DOUBLE) AS units_sold
  FROM lineitem GROUP BY 1)
"""

SALES_BY_NATION = """
SELECT series_key, date, revenue, units_sold, revenue / NULLIF(units_sold, 0) AS price
FROM (
  SELECT n_name AS series_key, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS date,
         """ + money_sum("l_extendedprice * (1 - l_discount)") + """ AS revenue,
         CAST(sum(l_quantity) AS DOUBLE) AS units_sold
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)
"""

ORDERS_BY_PRIORITY = """
SELECT series_key, date, revenue, units_sold, revenue / NULLIF(units_sold, 0) AS price
FROM (
  SELECT o_orderpriority AS series_key, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS date,
         """ + money_sum("o_totalprice") + """ AS revenue, CAST(count(*) AS DOUBLE) AS units_sold
  FROM orders GROUP BY 1, 2)
"""

EVENT_VALUE_DAILY = """
SELECT series_key, date, revenue, units_sold, revenue / NULLIF(units_sold, 0) AS price
FROM (
  SELECT event_type AS series_key, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS date,
         """ + money_sum("value") + """ AS revenue, CAST(count(*) AS DOUBLE) AS units_sold
  FROM events GROUP BY 1, 2)
"""

DIRTY_DAILY_BY_BRAND = """
SELECT series_key,
       strftime(date, '%Y-%m-%d') AS order_day,
       CASE WHEN day_no % 17 = 0 THEN NULL
            WHEN day_no % 23 = 0 THEN revenue * 50
            WHEN day_no % 31 = 0 THEN -revenue
            ELSE revenue END AS gross_sales,
       CASE WHEN day_no % 29 = 0 THEN 'n/a'
            WHEN day_no % 13 = 0 THEN NULL
            ELSE CAST(CAST(units_sold AS BIGINT) AS VARCHAR) END AS qty_sold,
       CAST(day_no AS BIGINT) AS seq
FROM (
  SELECT p_brand AS series_key, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS date,
         date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS day_no,
         """ + money_sum("l_extendedprice * (1 - l_discount)") + """ AS revenue,
         CAST(sum(l_quantity) AS DOUBLE) AS units_sold
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3)
"""

ACTIVITY_EVENTS = """
SELECT event_id, ts, CAST(user_id AS VARCHAR) AS username,
       'user ' || CAST(user_id AS VARCHAR) AS name, event_type AS action,
       CASE WHEN user_id % 3 = 0 THEN 'admin' WHEN user_id % 3 = 1 THEN 'analyst'
            ELSE 'viewer' END AS role
FROM events
"""


def features_sql(panel_sql: str, keys: list[str], extra: tuple[str, ...] = ()) -> str:
    """Feature table (D-01…D-09, back-fill parity) over a panel SELECT.

    ``extra`` columns pass through and join the order (``seq``).
    """
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    k = "".join(f"{c}, " for c in keys)
    order = ", ".join(("date",) + tuple(extra))
    x = "".join(f"{c}, " for c in extra)
    return f"""
WITH panel AS ({panel_sql}),
f0 AS (
  SELECT *,
    CAST(row_number() OVER w - 1 AS INTEGER) AS row_idx,
    lag(revenue, 1) OVER w AS l1, lag(revenue, 2) OVER w AS l2, lag(revenue, 3) OVER w AS l3,
    avg(revenue) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rm3,
    coalesce(stddev_samp(revenue) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0.0) AS rs3,
    avg(revenue) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS rm6,
    (revenue - lag(revenue, 1) OVER w) / NULLIF(lag(revenue, 1) OVER w, 0) * 100 AS gr,
    CASE WHEN max(price) OVER ({part}) > 0 THEN revenue / (price + 1e-9) END AS prr,
    max(price) OVER ({part}) AS max_price
  FROM panel WINDOW w AS ({part} ORDER BY {order}))
SELECT {k}date, {x}revenue,
  coalesce(first_value(units_sold IGNORE NULLS) OVER (w2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS units_sold,
  coalesce(first_value(price IGNORE NULLS) OVER (w2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS price,
  CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  CAST(quarter(date) AS INTEGER) AS quarter, CAST(dayofyear(date) AS INTEGER) AS day_of_year,
  sin(2 * pi() * month(date) / 12) AS month_sin, cos(2 * pi() * month(date) / 12) AS month_cos,
  coalesce(first_value(l1 IGNORE NULLS) OVER (w2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS lag_1,
  coalesce(first_value(l2 IGNORE NULLS) OVER (w2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS lag_2,
  coalesce(first_value(l3 IGNORE NULLS) OVER (w2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS lag_3,
  coalesce(first_value(rm3 IGNORE NULLS) OVER (w2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS rolling_mean_3,
  rs3 AS rolling_std_3,
  coalesce(first_value(rm6 IGNORE NULLS) OVER (w2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS rolling_mean_6,
  CASE WHEN gr IS NULL AND (row_idx = 0 OR (l1 = 0 AND revenue = 0))
       THEN coalesce(first_value(gr IGNORE NULLS) OVER (w2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0)
       ELSE gr END AS growth_rate,
  CASE WHEN max_price > 0 THEN
       coalesce(first_value(prr IGNORE NULLS) OVER (w2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0)
  END AS price_revenue_ratio,
  row_idx
FROM f0 WINDOW w2 AS ({part} ORDER BY {order})
"""


def features_drop_sql(panel_sql: str, keys: list[str]) -> str:
    """Feature table without each series' first three rows, positions counted anew."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"""
SELECT * REPLACE (CAST(row_number() OVER ({part}ORDER BY date) - 1 AS INTEGER) AS row_idx)
FROM ({features_sql(panel_sql, keys)}) WHERE row_idx >= 3"""


def quantile_sql(lst: str, q: float) -> str:
    """Linear-interpolated quantile of a sorted, null-free DuckDB list.

    Written as (h - p)·a + (p - l)·b, one IEEE-identical form of the
    interpolation, so both engines agree to the last bit.
    """
    n = f"len({lst})"
    pos = f"(({n} - 1) * CAST({q} AS DOUBLE))"
    lo, hi = f"CAST(floor({pos}) AS BIGINT)", f"CAST(ceil({pos}) AS BIGINT)"
    a, b = f"{lst}[{lo} + 1]", f"{lst}[{hi} + 1]"
    return (f"(CASE WHEN {n} = 0 THEN NULL WHEN {lo} = {hi} OR {a} = {b} THEN {a} "
            f"ELSE ({hi} - {pos}) * {a} + ({pos} - {lo}) * {b} END)")


def sorted_list_sql(expr: str, cond: str) -> str:
    return f"list_sort(list({expr}) FILTER (WHERE {cond} AND {expr} IS NOT NULL))"


_CLEAN_STAGE = """
WITH raw AS (""" + DIRTY_DAILY_BY_BRAND + """),
p AS (
  SELECT series_key, seq, CAST(try_strptime(order_day, '%Y-%m-%d') AS TIMESTAMP) AS date,
         TRY_CAST(gross_sales AS DOUBLE) AS revenue, TRY_CAST(qty_sold AS DOUBLE) AS units_raw
  FROM raw),
p2 AS (
  SELECT *, CASE WHEN units_raw > 0 THEN revenue / units_raw END AS price_raw,
         (date IS NULL OR revenue IS NULL) AS dropped
  FROM p),
lists AS (
  SELECT series_key,
         """ + sorted_list_sql("revenue", "NOT dropped") + """ AS rl,
         """ + sorted_list_sql("units_raw", "NOT dropped") + """ AS ul,
         """ + sorted_list_sql("price_raw", "NOT dropped") + """ AS pl
  FROM p2 GROUP BY series_key),
stats AS (
  SELECT series_key, """ + quantile_sql("rl", 0.25) + """ AS q1, """ + quantile_sql("rl", 0.75) + """ AS q3,
         """ + quantile_sql("ul", 0.5) + """ AS u_med, """ + quantile_sql("pl", 0.5) + """ AS p_med
  FROM lists),
s AS (
  SELECT p2.*, q1, q3,
    coalesce(last_value(CASE WHEN NOT dropped THEN units_raw END IGNORE NULLS) OVER ws, u_med) AS units_sold,
    coalesce(last_value(CASE WHEN NOT dropped THEN price_raw END IGNORE NULLS) OVER ws, p_med) AS price
  FROM p2 JOIN stats USING (series_key)
  WINDOW ws AS (PARTITION BY series_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s2 AS (
  SELECT *, q3 + 3.0 * (q3 - q1) AS hi, greatest(0.0, q1 - 3.0 * (q3 - q1)) AS lo FROM s)
"""

CLEAN_DIRTY_DAILY = _CLEAN_STAGE + """
SELECT series_key, date, greatest(lo, least(hi, revenue)) AS revenue, units_sold, price, seq
FROM s2 WHERE NOT dropped
"""

CLEAN_LOG_DIRTY_DAILY = _CLEAN_STAGE + """,
c AS (
  SELECT count(*) AS n_raw, count(*) FILTER (WHERE dropped) AS n_removed,
         count(*) FILTER (WHERE NOT dropped AND (revenue < lo OR revenue > hi)) AS n_out
  FROM s2),
m AS (
  SELECT 0 AS i, 'info' AS type, printf('Loaded %d rows and %d columns.', n_raw, 5) AS msg, true AS keep FROM c
  UNION ALL SELECT 1, 'success', 'Date column "order_day" parsed successfully.', true FROM c
  UNION ALL SELECT 2, 'success', 'Units column: "qty_sold".', true FROM c
  UNION ALL SELECT 3, 'info', 'Price derived from Revenue / Units_Sold.', true FROM c
  UNION ALL SELECT 4, 'warning', printf('Removed %d rows with missing Date or Revenue.', n_removed), n_removed > 0 FROM c
  UNION ALL SELECT 5, 'warning', printf('Capped %d revenue outliers using 3×IQR rule.', n_out), n_out > 0 FROM c
  UNION ALL SELECT 6, 'success', printf('Cleaning complete. %d clean rows ready.', n_raw - n_removed), true FROM c)
SELECT CAST(row_number() OVER (ORDER BY i) AS INTEGER) AS seq, type, msg FROM m WHERE keep
"""


def clean_sql(raw: str, key: str | None) -> str:
    """The cleaned table of ``raw(k, seq, date, revenue, units_raw, price_raw)`` in which dates all parse."""
    part = "PARTITION BY k " if key else ""
    group = "k" if key else "()"
    on = "p2.k IS NOT DISTINCT FROM stats.k" if key else "true"
    return f"""
WITH raw AS ({raw}),
p2 AS (SELECT *, (date IS NULL OR revenue IS NULL) AS dropped FROM raw),
lists AS (SELECT {'k, ' if key else ''}{sorted_list_sql("revenue", "NOT dropped")} AS rl, {sorted_list_sql("units_raw", "NOT dropped")} AS ul,
                 {sorted_list_sql("price_raw", "NOT dropped")} AS pl FROM p2 GROUP BY {group}),
stats AS (SELECT {'k, ' if key else ''}{quantile_sql("rl", 0.25)} AS q1, {quantile_sql("rl", 0.75)} AS q3,
                 {quantile_sql("ul", 0.5)} AS u_med, {quantile_sql("pl", 0.5)} AS p_med FROM lists),
s AS (SELECT p2.*, q3 + 3.0 * (q3 - q1) AS hi, greatest(0.0, q1 - 3.0 * (q3 - q1)) AS lo,
        coalesce(last_value(CASE WHEN NOT dropped THEN units_raw END IGNORE NULLS) OVER ws, u_med) AS units_sold,
        coalesce(last_value(CASE WHEN NOT dropped THEN price_raw END IGNORE NULLS) OVER ws, p_med) AS price
      FROM p2 JOIN stats ON {on}
      WINDOW ws AS ({part.replace('BY k', 'BY p2.k')}ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT {f'k AS {key}, ' if key else ''}date, greatest(lo, least(hi, revenue)) AS revenue, units_sold, price, seq FROM s WHERE NOT dropped"""


#: Raw order lines: one series holds half of the rows, half of its prices are one price,
#: and the key is missing in some rows.
SKEWED_RAW = """
SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'hot' WHEN l_partkey % 5 = 0 THEN NULL ELSE l_returnflag END AS k,
       l_orderkey * 10000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS seq, CAST(l_shipdate AS TIMESTAMP) AS date,
       CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_suppkey % 97 = 1 THEN l_extendedprice * 50 ELSE l_extendedprice END AS revenue,
       CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity END AS units_raw,
       CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_orderkey % 4 = 0 THEN 99.0::DOUBLE ELSE l_extendedprice / l_quantity END AS price_raw
FROM lineitem"""
