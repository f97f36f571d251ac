"""A-05, H-02: report sinks.

Each section is written as its own CSV directory (header, quoted fields) by
the executors; no section passes through the driver, so the cleaned-data
section may be as large as the input. ``report_lines`` builds the one-file
text layout of the small sections as a DataFrame for ``write.text``.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelcast.functions.numbers import plain
from panelcast.operators.chunked import KEY, series_key
from panelcast.operators.long_features import positions

# Report title; fixed values: section headings.
TITLE = "=== SALES PANEL REPORT ==="
# What orders the rows of a section, as far as it has the columns.
ORDER = ("series_key", "line_no", "step", "rank", "date", "seq")
HEADINGS = {
    "summary": "--- SUMMARY STATISTICS ---",
    "models": "--- MODEL EVALUATION ---",
    "cleaned": "--- CLEANED DATA ---",
    "forecast": "--- FORECAST ---",
    "importance": "--- FEATURE IMPORTANCE ---",
}


def ordering(df: DataFrame) -> list[str]:
    """The ``ORDER`` columns that a section has, else all of its columns."""
    return [c for c in ORDER if c in df.columns] or df.columns


def write_report(path: str, sections: Mapping[str, DataFrame | None], mode: str = "overwrite") -> list[str]:
    """Write every present section under ``path/<name>``; returns the names written.

    A section's rows are in order (``ordering``) over its files: a range sort, so no task
    holds more than a range.
    """
    written = []
    for name, df in sections.items():
        if df is None:
            continue
        df.orderBy(*ordering(df)).write.mode(mode).option("header", True).option("quoteAll", False).csv(os.path.join(path, name))
        written.append(name)
    return written


def report_lines(sections: Mapping[str, DataFrame | None]) -> DataFrame:
    """H-02: ``(section_no, line_no, text)``; absent sections are skipped.

    Each section's rows are rendered as CSV text (fields with a comma, quote
    or line break are quoted) under its heading, in its ``ordering``. ``line_no`` numbers the
    lines of a section from 0 without gaps: rows are laid out in sorted ranges and numbered
    by their place in the range plus the rows before it. Write with
    ``orderBy("section_no", "line_no").write.text(path)``.
    """
    frames = []
    present = [(n, df) for n, df in sections.items() if df is not None]
    if not present:
        raise ValueError("no sections")
    spark = present[0][1].sparkSession
    frames.append(spark.createDataFrame([(0, 0, TITLE)], "section_no int, line_no bigint, text string"))
    for i, (name, df) in enumerate(present, start=1):
        cols = df.columns
        head = spark.createDataFrame(
            [(i, 0, HEADINGS.get(name, f"--- {name.upper()} ---")), (i, 1, ",".join(cols))],
            "section_no int, line_no bigint, text string")
        def field(c):
            text = plain(F.col(c)) if isinstance(df.schema[c].dataType, DoubleType) else F.col(c).cast("string")
            v = F.coalesce(text, F.lit(""))
            quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
            return F.when(v.rlike('[,"\r\n]'), quoted).otherwise(v)
        placed = positions(df.withColumn(KEY, series_key([])), ordering(df))
        body = placed.select(F.lit(i).alias("section_no"), (F.col("_pos") + 2).alias("line_no"),
                             F.concat_ws(",", *[field(c) for c in cols]).alias("text"))
        frames += [head, body]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
