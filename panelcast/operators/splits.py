"""M-02, M-03: temporal hold-out and contiguous K-fold labels per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.common import series_window

# Hold-out share, tail cap, fold counts and the small-series cut.
TEST_RATIO = 0.2
MAX_TEST = 6
CV_SPLITS = 5
CV_SPLITS_SMALL = 3
SMALL_SERIES = CV_SPLITS * 4


def with_splits(features: DataFrame, keys: Sequence[str] = (), test_ratio: float = TEST_RATIO,
                max_test: int = MAX_TEST) -> DataFrame:
    """Add ``n_rows``, ``split_idx``, ``is_test`` and ``fold`` per row.

    ``split_idx = max(floor(n·(1−r)), n−max_test)`` rows train, the rest test
    (so the test tail is at most ``max_test`` rows). Folds are contiguous by
    position, the first ``n mod k`` folds one row longer; series shorter than
    ``k`` get no fold. Window columns only: no shuffle beyond the series one.
    """
    keys = list(keys)
    out = features
    if "row_idx" not in out.columns:
        out = out.withColumn("row_idx", (F.row_number().over(series_window(out, keys)) - 1).cast("int"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = out.withColumn("n_rows", n.cast("int"))
    n, rn = F.col("n_rows"), F.col("row_idx")
    split_idx = F.greatest(F.floor(n * float(1 - test_ratio)), n - max_test).cast("int")
    k = F.when(n >= SMALL_SERIES, CV_SPLITS).otherwise(CV_SPLITS_SMALL)
    base = F.floor(n / k).cast("int")
    rem = (n % k).cast("int")
    long_fold = base + 1
    fold = (F.when(n < k, F.lit(None))
            .when(rn < rem * long_fold, F.floor(rn / long_fold))
            .otherwise(rem + F.floor(F.try_divide(rn - rem * long_fold, base)))).cast("int")
    return out.withColumns({"split_idx": split_idx, "is_test": rn >= split_idx,
                            "n_folds": k.cast("int"), "fold": fold})
