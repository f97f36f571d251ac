"""C-01…C-13: coerce a raw sales table to the canonical panel, with a log.

Rows dropped for a missing date or revenue stay in the staged rows behind a flag
and are masked out of fills and quantiles, so the validation log is a single
aggregate over the same stage. A series may be of any length and may be most of
the table: see ``panelcast.operators.chunked``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from panelcast.functions import dates
from panelcast.functions.dates import add_months
from panelcast.functions.roles import resolve_roles
from panelcast.operators import chunked
from panelcast.operators.common import nan_to_null
from panelcast.sources.scratch import written

REGENERATED_START = "2022-01-01"
IQR_MULTIPLIER = 3.0

# Validation log messages (type, template).
MSG_LOADED = ("info", "Loaded %d rows and %d columns.")
MSG_NO_DATE = ("warning", 'No date column detected. Using "%s" as date.')
MSG_DATE_OK = ("success", 'Date column "%s" parsed successfully.')
MSG_DATE_BAD = ("error", 'Could not parse "%s" as dates. Please check format.')
MSG_NO_REVENUE = ("warning", 'No revenue column detected. Using "%s".')
MSG_REVENUE_NONE = ("error", "No numeric revenue column found.")
MSG_UNITS_OK = ("success", 'Units column: "%s".')
MSG_UNITS_NONE = ("warning", "No units column found. Setting to NaN.")
MSG_PRICE_OK = ("success", 'Price column: "%s".')
MSG_PRICE_DERIVED = ("info", "Price derived from Revenue / Units_Sold.")
MSG_REMOVED = ("warning", "Removed %d rows with missing Date or Revenue.")
MSG_CAPPED = ("warning", "Capped %d revenue outliers using 3×IQR rule.")
MSG_DONE = ("success", "Cleaning complete. %d clean rows ready.")

_DATE_TYPES = (DateType, TimestampType, TimestampNTZType)


def _numeric(df: DataFrame, name: str | None) -> Column:
    if name is None:
        return F.lit(None).cast("double")
    return nan_to_null(F.col(name).try_cast("double"))


def clean_sales(df: DataFrame, keys: Sequence[str] = (), overrides: dict | None = None,
                seq: str | None = None, on_bad_dates: str = "regenerate",
                formats: Sequence[str] | None = None,
                chunk_rows: int = chunked.CHUNK_ROWS, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Return ``(clean, log)``.

    ``clean``: ``keys…, date TIMESTAMP_NTZ, revenue, units_sold, price DOUBLE, seq``.
    ``log``: ``(seq INT, type, msg)`` in reference order, totals over all series.
    ``seq`` names the original row order (needed for the forward fill); when
    absent, ``monotonically_increasing_id`` is used, which follows file order
    only as far as the input partitions do.

    Nothing is computed per whole series: rows are sorted in ranges of (series, ``seq``),
    exchanged on (series, chunk of at most ``chunk_rows`` rows) and written to the shared
    folder; fills, positions and exact quantiles come from ``panelcast.operators.chunked``.
    So a call runs these passes at once, and ``clean`` reads the written rows. ``seq`` may
    be of any ordered type and have any gaps. ``ordered`` sorts ``clean`` by keys, date and ``seq``
    (C-13, a range sort); operators on series order their own windows and don't need it.
    """
    if on_bad_dates not in ("regenerate", "null"):
        raise ValueError("on_bad_dates must be 'regenerate' or 'null'")
    keys = list(keys)
    n_cols = len(df.columns)
    if seq is None:
        if "seq" in df.columns:
            seq = "seq"
        else:
            df = df.withColumn("seq", F.monotonically_increasing_id())
            seq = "seq"
    roles = resolve_roles(df, overrides, exclude=keys + [seq])
    msgs: list[tuple[tuple[str, str], Column | None, Column]] = []  # (msg, arg, keep)
    true = F.lit(True)

    # Date (C-01, C-02). A text column is read by its one layout (a lazy scalar
    # subquery); without one, dates are regenerated.
    dcol = roles["date"]
    if roles["date_how"] == "fallback":
        msgs.append((MSG_NO_DATE, F.lit(dcol), true))
    unknown = F.lit(None).cast("timestamp_ntz")
    if dcol is not None and isinstance(df.schema[dcol].dataType, _DATE_TYPES):
        date_expr, date_ok = F.col(dcol).cast("timestamp_ntz"), F.lit(True)
    elif dcol is not None and not isinstance(df.schema[dcol].dataType, NumericType):
        # The subquery is referenced once, as a column; the CASE reads the column.
        if formats is None:
            df = dates.with_readings(df, dcol, "_read")
            df = df.withColumn("_fmt", dates.layout(df, "_read", dcol))
            date_expr = dates.parsed(F.col("_read"), F.col("_fmt"))
        else:
            df = df.withColumn("_fmt", dates.format_index(df, dcol, formats))
            date_expr = unknown
            for i in reversed(range(len(formats))):
                date_expr = F.when(F.col("_fmt") == i, dates.parse_with(F.col(dcol), formats[i])).otherwise(date_expr)
        date_ok = None
    else:
        date_expr, date_ok = unknown, F.lit(False)
    dynamic_date = date_ok is None
    if dynamic_date:  # decided by the scalar, read back in the log aggregate
        date_ok = F.col("date_ok")
    msgs.append((MSG_DATE_OK, F.lit(dcol), date_ok))
    msgs.append((MSG_DATE_BAD, F.lit(str(dcol)), ~date_ok))

    # Revenue, units, price (C-03…C-05)
    rcol = roles["revenue"]
    if roles["revenue_how"] == "fallback":
        msgs.append((MSG_NO_REVENUE, F.lit(rcol), true))
    if rcol is None:
        msgs.append((MSG_REVENUE_NONE, None, true))
    ucol = roles["units"]
    msgs.append((MSG_UNITS_OK, F.lit(ucol), true) if ucol else (MSG_UNITS_NONE, None, true))
    pcol = roles["price"]
    revenue = _numeric(df, rcol)
    units = _numeric(df, ucol)
    if pcol:
        msgs.append((MSG_PRICE_OK, F.lit(pcol), true))
        price = _numeric(df, pcol)
    else:
        msgs.append((MSG_PRICE_DERIVED, None, true))
        price = F.when(units > 0, revenue / units)

    # Canonical projection (C-06); dropped rows flagged, not removed (C-07). Dates that
    # are made from positions are never missing.
    made = F.col("_made") & F.lit(on_bad_dates == "regenerate")
    proj = df.select(chunked.series_key(keys).alias(chunked.KEY), date_expr.alias("date"), revenue.alias("revenue"),
                     units.alias("_u"), price.alias("_p"), F.col(seq).alias("seq"), F.col(seq).alias("_order"),
                     (F.col("_fmt") if dynamic_date else F.lit(None).cast("int")).alias("_fmt"),
                     (F.col("_fmt").isNull() if dynamic_date else ~date_ok).alias("_made"))
    proj = proj.withColumn("_dropped", F.col("revenue").isNull() | (F.col("date").isNull() & ~made))
    kept = ~F.col("_dropped")
    proj = proj.withColumns({"_u": F.when(kept, F.col("_u")), "_p": F.when(kept, F.col("_p")), "_r": F.when(kept, F.col("revenue"))})

    # Last value and position within a chunk, then what earlier chunks carry over (C-02, C-08);
    # medians and the IQR's quantiles (C-09, C-10).
    rows = chunked.local(proj, ["_u", "_p"], "_order", chunk_rows)
    stats = chunked.quantiles(rows, [("_u", 0.5, "_mid_u"), ("_p", 0.5, "_mid_p"), ("_r", 0.25, "_q1"), ("_r", 0.75, "_q3")])
    per_chunk = written(chunked.carried(rows, ["_u", "_p"]).join(stats, chunked.KEY, "left"))
    stage = chunked.ordered_rows(rows, "_order").join(per_chunk, [chunked.KEY, chunked.CHUNK])
    position = (F.col("_before") + F.col("_nth") - 1).cast("int")
    stage = stage.withColumns({
        "date": F.when(made, add_months(F.lit(REGENERATED_START).cast("date"), position)).otherwise(F.col("date")),
        "units_sold": F.coalesce("_last_0", "_carry_0", "_mid_u"),
        "price": F.coalesce("_last_1", "_carry_1", "_mid_p"),
        "_q": F.array("_q1", "_q3")})
    # Cap (C-11).
    iqr = F.col("_q")[1] - F.col("_q")[0]
    hi = F.col("_q")[1] + IQR_MULTIPLIER * iqr
    lo = F.greatest(F.lit(0.0), F.col("_q")[0] - IQR_MULTIPLIER * iqr)
    rev = F.col("revenue")
    stage = stage.withColumns({
        "_outlier": kept & ((rev < lo) | (rev > hi)),
        "revenue": F.greatest(lo, F.least(hi, rev)),
    })
    clean = stage.filter(kept).select(*[F.col(chunked.KEY)[k].alias(k) for k in keys], "date", "revenue", "units_sold", "price", "seq")

    if ordered:
        clean = clean.orderBy(*keys, "date", "seq")

    # Validation log (C-12): one aggregate, then one row per message.
    counts = stage.agg(F.count(F.lit(1)).alias("n_raw"),
                       F.count_if(F.col("_dropped")).alias("n_removed"),
                       F.count_if(F.col("_outlier")).alias("n_outliers"),
                       F.max("_fmt").alias("_fmt"))
    # An empty table parses trivially.
    counts = counts.withColumn("date_ok", F.col("_fmt").isNotNull() | (F.col("n_raw") == 0))
    n_raw, n_removed, n_out = F.col("n_raw"), F.col("n_removed"), F.col("n_outliers")
    ordered = [(MSG_LOADED, [n_raw, F.lit(n_cols)], true)]
    ordered += [(m, [a] if a is not None else [], k) for m, a, k in msgs]
    ordered += [(MSG_REMOVED, [n_removed], n_removed > 0),
                (MSG_CAPPED, [n_out], n_out > 0),
                (MSG_DONE, [n_raw - n_removed], true)]
    entries = [F.struct(F.lit(i).alias("seq"), F.lit(t).alias("type"),
                        (F.format_string(tpl, *args) if args else F.lit(tpl)).alias("msg"),
                        keep.alias("_keep"))
               for i, ((t, tpl), args, keep) in enumerate(ordered)]
    log = (counts.select(F.inline(F.array(*entries)))
           .filter("_keep").drop("_keep")
           .withColumn("seq", F.row_number().over(Window.orderBy("seq")).cast("int")))
    return clean, log
