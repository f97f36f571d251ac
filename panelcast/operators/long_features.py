"""D-01…D-09 for series of any length: chunks with halos instead of a window per series.

Rows are laid out in ranges of (series, date, seq), which gives each row its position in
its series; positions are cut into blocks. A block's neighbours send it copies of their
nearest rows (``ROWS_BACK`` from before, ``ROWS_AHEAD`` from after), so all lags, rolling
frames and head fills of a block are computed within it and the copies go again. What
may look further ahead, the back-fill of units, price, ratio and undefined growth, goes
through a table of one row per block, like a series' greatest price.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.chunked import KEY, series_key
from panelcast.operators.common import order_cols
from panelcast.operators.features import ROWS_AHEAD, ROWS_BACK, growth_to_fill, head_filled, raw_features, without_head
from panelcast.sources.scratch import written

#: Positions in a block.
BLOCK_ROWS = 1 << 16
_FILLED = ("growth_rate", "units_sold", "price", "price_revenue_ratio")


def _part(at: str = "_at") -> Column:
    return F.shiftright(at, 33)


def positions(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``_pos``, the place in the series (``KEY``) along ``order``, from 0.

    The position is the place in a sorted range plus the series' rows in earlier ranges;
    rows equal in ``order`` get some order of their own."""
    cols = [F.col(KEY), *[F.col(c).asc_nulls_first() for c in order], "_tie"]
    rows = written(written(df).withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*cols)
                   .sortWithinPartitions(*cols).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    spans = rows.groupBy(_part().alias("_range"), KEY).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    past = Window.partitionBy(KEY).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = written(spans.withColumn("_past", F.coalesce(F.sum("_rows").over(past), F.lit(0)) - F.col("_first")).drop("_first", "_rows"))
    # The range is part of the key, so the rows of one series meet their spans in many tasks.
    return (rows.withColumn("_range", _part()).join(spans, ["_range", KEY])
            .withColumn("_pos", F.col("_at") + F.col("_past")).drop("_range", "_at", "_past"))


def with_halos(df: DataFrame, block_rows: int) -> DataFrame:
    """Each row in its block, and copies (``_own`` false) in the next and previous block where it is near their edge."""
    block, inside = F.expr(f"_pos div {int(block_rows)}"), F.col("_pos") % block_rows
    homes = F.array(F.struct(block.alias("_block"), F.lit(True).alias("_own")),
                    F.when(inside >= block_rows - ROWS_BACK, F.struct((block + 1).alias("_block"), F.lit(False).alias("_own"))),
                    F.when((inside < ROWS_AHEAD) & (block > 0), F.struct((block - 1).alias("_block"), F.lit(False).alias("_own"))))
    return df.select("*", F.inline(F.array_compact(homes)))


def add_long_features(panel: DataFrame, keys: Sequence[str] = (), fill: str = "bfill", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``add_features`` with the same results, for series that may be most of the table."""
    if fill not in ("bfill", "drop"):
        raise ValueError("fill must be 'bfill' or 'drop'")
    if block_rows < ROWS_BACK:
        raise ValueError(f"a block holds at least {ROWS_BACK} rows")
    placed = positions(panel.withColumn(KEY, series_key(keys)), order_cols(panel))
    blocks = with_halos(placed, block_rows)
    w = Window.partitionBy(KEY, "_block").orderBy("_pos")
    # Whether a series has a price is known only from its blocks; the ratio is masked below.
    stage = raw_features(blocks, w, F.col("_pos").cast("int"), F.lit(True))
    out = panel.columns + [c for c in stage.columns if c not in (*blocks.columns, "_base")]
    dear = Window.partitionBy(KEY)
    if fill == "drop":
        stage = written(stage.where("_own"))
        top = stage.groupBy(KEY).agg((F.max("price") > 0).alias("_priced"))
        got = without_head(stage).join(top, KEY)
        return got.withColumn("price_revenue_ratio", F.when(F.col("_priced"), F.col("price_revenue_ratio"))).select(out)

    stage = stage.withColumns({**head_filled(w), "_gap": growth_to_fill()}).where("_own")
    back = Window.partitionBy(KEY, "_block").orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stage = written(stage.withColumns({**{f"_next_{c}": F.last(c, ignorenulls=True).over(back) for c in _FILLED},
                                       "_top": F.max("price").over(Window.partitionBy(KEY, "_block"))}))
    # A block's first row has found the block's first values; a series has as many rows here as blocks.
    later = Window.partitionBy(KEY).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    first = written(stage.where(F.col("_pos") % block_rows == 0).select(
        KEY, "_block", *[F.last(f"_next_{c}", ignorenulls=True).over(later).alias(f"_later_{c}") for c in _FILLED],
        (F.max("_top").over(dear) > 0).alias("_priced")))
    stage = stage.join(first, [KEY, "_block"])
    found = {c: F.coalesce(f"_next_{c}", f"_later_{c}", F.lit(0.0)) for c in _FILLED}
    return stage.withColumns({
        "growth_rate": F.when(F.col("_gap"), found["growth_rate"]).otherwise(F.col("growth_rate")),
        "units_sold": found["units_sold"], "price": found["price"],
        "price_revenue_ratio": F.when(F.col("_priced"), found["price_revenue_ratio"])}).select(out)
