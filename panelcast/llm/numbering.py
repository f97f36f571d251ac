"""Row numbers of a total order, without a task that sees the whole table or a whole group.

The rows are laid out in ranges of the order, each sorted; a number is the place in
its range plus the counts of the ranges before. Rows that are equal in all order
columns are told apart by their place in the input alone, so a key that fills a third
of the table is split over many ranges, and which of the equal rows gets which number
doesn't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.components import written

#: Most rows of a range; the session's shuffle partitions are the least number of ranges.
RANGE_ROWS = 1 << 17


def laid_out(df: DataFrame, group: Sequence[str], order: Sequence[str],
             range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows in ranges of (group, order), nulls first, and the spans of the groups.

    Rows get ``_at``: the range in the upper bits, the place in it in the lower 33.
    A span is one row per range and group: ``_part`` (the range), the group's columns,
    ``_first`` (its first ``_at``), ``_here`` (rows), ``_before`` (rows of the group in
    earlier ranges), ``_size`` (rows of the group) and ``_group`` (the group's place among
    all groups, from 0). ``df`` should be a written table: it is read twice, for the
    bounds and for the rows. An empty table gives no spans.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // range_rows))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    salt = F.xxhash64(F.monotonically_increasing_id())
    rows = written(df.withColumn("_salt", salt).repartitionByRange(parts, *keys, "_salt")
                   .sortWithinPartitions(*keys, "_salt").drop("_salt").withColumn("_at", F.monotonically_increasing_id()))
    spans = rows.groupBy(_part().alias("_part"), *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_here"))
    of_group = Window.partitionBy(*group)
    past = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = written(spans.withColumns({"_before": F.coalesce(F.sum("_here").over(past), F.lit(0)),
                                       "_size": F.sum("_here").over(of_group)}))
    new = (F.col("_before") == 0).cast("long")
    # One row per range: as many as shuffle partitions, so one task may order them.
    starts = (spans.groupBy("_part").agg(F.sum(new).alias("_new"))
              .select("_part", (F.sum("_new").over(Window.orderBy("_part")) - F.col("_new")).alias("_ahead")))
    inside = Window.partitionBy("_part").orderBy("_first")
    spans = (spans.withColumn("_nth", F.sum(new).over(inside)).join(starts, "_part")
             .withColumn("_group", F.col("_ahead") + F.col("_nth") - 1).drop("_nth", "_ahead"))
    return rows, written(spans)


def _part():
    return F.shiftright("_at", 33)


def with_spans(rows: DataFrame, spans: DataFrame, group: Sequence[str]) -> DataFrame:
    """The rows with their span's columns and ``_index``, the place in the group from 0.

    The join key holds the range, so a hot group's rows meet in many tasks."""
    r, s = rows.withColumn("_part", _part()).alias("r"), spans.alias("s")
    same = F.col("r._part") == F.col("s._part")
    for c in group:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    extra = [c for c in spans.columns if c not in group and c != "_part"]
    return (r.join(s, same).select("r.*", *[f"s.{c}" for c in extra])
            .withColumn("_index", F.col("_at") - F.col("_first") + F.col("_before")))
