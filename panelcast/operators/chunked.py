"""Per-series scans over chunks of a series, so that no task holds a whole one.

Rows are laid out in sorted ranges of (series, order column) and cut into chunks by their
place in the layout, so a chunk is full whatever gaps the order column has. One exchange
on (series, chunk) serves everything a chunk can tell by itself; what passes from chunk
to chunk goes through a table of one row per chunk, a small share of the rows:

- ``local``: last value so far, position in the chunk, and the chunk's last row, in
  one pass over the exchanged rows, written once;
- ``carried``: what a chunk gets from the ones before it (values to fill from, rows
  before it), a window over the chunk table alone;
- ``quantiles``: exact quantiles by refined histograms. Values are counted in bins of
  their logarithm; the bins that hold the wanted ranks are cut into equal widths and
  counted again, until each holds one value. Every step is a map-side combined count
  and a window over at most ``BINS`` + 1 bins, whatever a series' size or ties.

Series are told apart by a struct of the keys (``KEY``), in which null equals null,
so plain equi-joins serve null keys and the one series without keys alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from panelcast.sources.scratch import written

#: Places of the sorted layout in a chunk, and bins of a refined histogram.
CHUNK_ROWS = 1 << 16
BINS = 1 << 14
#: Bins per e-fold of the first histogram.
FOLD = 64
KEY, CHUNK = "_key", "_chunk"


def series_key(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))


def in_order(df: DataFrame, order: str) -> DataFrame:
    """Adds ``_at``, which ascends along (series, ``order``): a place in a layout of sorted ranges.

    ``order`` may have gaps and be of any ordered type; rows of one series that are equal in it
    keep the order they come in."""
    cols = [F.col(KEY), F.col(order), F.col("_tie")]
    # Written before it is sorted, as the bounds of the ranges take a pass of their own.
    rows = written(df.withColumn("_tie", F.monotonically_increasing_id()))
    return rows.repartitionByRange(*cols).sortWithinPartitions(*cols).drop("_tie").withColumn("_at", F.monotonically_increasing_id())


def local(df: DataFrame, cols: Sequence[str], order: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds per chunk: ``_last_i`` (last non-null value of column i so far), ``_nth`` (position
    from 1) and ``_end`` (true on the last row)."""
    d = in_order(df, order).withColumn(CHUNK, F.floor(F.col("_at") / F.lit(chunk_rows)).cast("long"))
    w = Window.partitionBy(KEY, CHUNK).orderBy("_at")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return written(d.withColumns({
        **{f"_last_{i}": F.last(c, ignorenulls=True).over(so_far) for i, c in enumerate(cols)},
        "_nth": F.row_number().over(w), "_end": F.lead(F.lit(1)).over(w).isNull()}).drop("_at"))


def ordered_rows(rows: DataFrame, order: str) -> DataFrame:
    """The rows that have a place: those without a value in an integer ``order`` have none."""
    return rows.where(F.col(order).isNotNull()) if isinstance(rows.schema[order].dataType, IntegralType) else rows


def carried(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per chunk: ``_carry_i`` (last value of column i in earlier chunks) and ``_before`` (rows in them)."""
    past = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return rows.where("_end").select(
        KEY, CHUNK, *[F.last(f"_last_{i}", ignorenulls=True).over(past).alias(f"_carry_{i}") for i in range(len(cols))],
        F.coalesce(F.sum("_nth").over(past), F.lit(0)).cast("long").alias("_before"))


def forward_fill(df: DataFrame, cols: Sequence[str], keys: Sequence[str], order: str,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Last non-null value at or before each row, along ``order``, per series."""
    rows = local(df.withColumn(KEY, series_key(keys)), cols, order, chunk_rows)
    out = ordered_rows(rows, order).join(carried(rows, cols), [KEY, CHUNK])
    return out.select(*[F.coalesce(f"_last_{list(cols).index(c)}", f"_carry_{list(cols).index(c)}").alias(c) if c in cols else c
                        for c in df.columns])


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, chunk_rows: int = CHUNK_ROWS,
                name: str = "_rn") -> DataFrame:
    """1-based position along ``order`` per series."""
    rows = local(df.withColumn(KEY, series_key(keys)), [], order, chunk_rows)
    return ordered_rows(rows, order).join(carried(rows, []), [KEY, CHUNK]).select(*df.columns, (F.col("_before") + F.col("_nth")).alias(name))


# ---------------------------------------------------------------- quantiles

def _log_bin(v: Column) -> Column:
    """Bin by logarithm on either side of zero; never decreases with the value."""
    size = F.floor(F.least(F.log1p(F.abs(v)) * FOLD, F.lit(1e6))).cast("long") + 1
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))


def _width_bin(v: Column, low: Column, high: Column) -> Column:
    """Equal widths between two unequal bounds; the bounds fall into different bins."""
    return F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * BINS).cast("long")


def _steps(values: DataFrame, node: list[str], bin_: Column) -> DataFrame:
    """Histogram of ``v`` per node: each bin's bounds and the number of values before it and in it."""
    hist = values.groupBy(*node, bin_.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    past = Window.partitionBy(*node).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("_past", F.coalesce(F.sum("_n").over(past), F.lit(0)))


def quantiles(df: DataFrame, specs: Sequence[tuple[str, float, str]]) -> DataFrame:
    """One row per series (``KEY``) with a value, one column per ``(column, q, name)`` spec.

    Equal to ``percentile(column, q)`` per series. Reads ``df`` twice, so it should be a
    written table.
    """
    cols = list(dict.fromkeys(c for c, _, _ in specs))
    long = df.select(KEY, F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v"))
                                              for i, c in enumerate(cols)])).alias("t")).select(KEY, "t.*").where("v IS NOT NULL")
    first = written(_steps(long, [KEY, "c"], _log_bin(F.col("v"))))
    total = F.sum("_n").over(Window.partitionBy(KEY, "c"))
    pos = [(cols.index(c), i, (F.col("_total") - 1).cast("double") * F.lit(float(q))) for i, (c, q, _) in enumerate(specs)]
    ranks = F.filter(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(i).alias("spec"), F.lit(up).alias("up"), p.alias("pos"),
                                        (F.ceil(p) if up else F.floor(p)).cast("long").alias("rank"))
                               for c, i, p in pos for up in (False, True)]), lambda r: r["c"] == F.col("c"))
    wanted = (first.withColumn("_total", total).select(KEY, "c", "_bin", "_lo", "_hi", "_past", "_n", F.explode(ranks).alias("r"))
              .where("r.rank >= _past AND r.rank < _past + _n")
              .select(KEY, "c", "_bin", "_lo", "_hi", "r.spec", "r.up", "r.pos", (F.col("r.rank") - F.col("_past")).alias("rank")))
    wanted = written(wanted)
    found, rest = [wanted.where("_lo = _hi")], wanted.where("_lo < _hi")
    values = long.withColumn("_bin", _log_bin(F.col("v")))
    while rest.limit(1).count():
        nodes = rest.select(KEY, "c", "_bin", F.col("_lo").alias("low"), F.col("_hi").alias("high")).distinct()
        # A bin is known by its least value, so bins of all levels have names of one type.
        values = written(values.join(nodes, [KEY, "c", "_bin"]).select(
            KEY, "c", F.col("low").alias("node"), "high", "v", _width_bin(F.col("v"), F.col("low"), F.col("high")).alias("_bin")))
        steps = _steps(values, [KEY, "c", "node"], F.col("_bin"))
        wanted = written(steps.join(rest.select(KEY, "c", F.col("_lo").alias("node"), "spec", "up", "pos", "rank"), [KEY, "c", "node"])
                         .where("rank >= _past AND rank < _past + _n")
                         .select(KEY, "c", "node", "_bin", "_lo", "_hi", "spec", "up", "pos", (F.col("rank") - F.col("_past")).alias("rank")))
        found.append(wanted.where("_lo = _hi"))
        rest = wanted.where("_lo < _hi")
        # The next round's bins lie within this round's nodes.
        values, rest = _below(values, rest)
    got = found[0].select(KEY, "spec", "up", "pos", "_lo")
    for f in found[1:]:
        got = got.unionByName(f.select(KEY, "spec", "up", "pos", "_lo"))
    out = got.groupBy(KEY).agg(*[e for i in range(len(specs)) for e in (
        F.max(F.when((F.col("spec") == i) & ~F.col("up"), F.col("_lo"))).alias(f"_a{i}"),
        F.max(F.when((F.col("spec") == i) & F.col("up"), F.col("_lo"))).alias(f"_b{i}"),
        F.max(F.when(F.col("spec") == i, F.col("pos"))).alias(f"_p{i}"))])
    return out.select(KEY, *[_between(F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_p{i}")).alias(name)
                             for i, (_, _, name) in enumerate(specs)])


def _below(values: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values and wanted ranks with one name per bin: the node's and the bin's within it."""
    name = F.struct(F.col("node").alias("n"), F.col("_bin").alias("b")).alias("_bin")
    return (values.select(KEY, "c", "v", name), rest.select(KEY, "c", name, "_lo", "_hi", "spec", "up", "pos", "rank"))


def _between(a: Column, b: Column, pos: Column) -> Column:
    low, high = F.floor(pos), F.ceil(pos)
    return F.when((low == high) | (a == b), a).otherwise((high - pos) * a + (pos - low) * b)
