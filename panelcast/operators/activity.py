"""F-01…F-05: activity-log analytics over an event table.

Expressions only (filters, conditional counts, formatting), so the same
functions run on a batch table or on a stream (see ``panelcast.streaming``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The actions the log counts, and the timestamp layout.
LOG_ACTIONS = ["Login", "Logout", "Registered"]
LOG_TIMESTAMP_FORMAT = "dd MMM yyyy  HH:mm:ss"
ALL = "All"


def _predicate(action: str = ALL, role: str = ALL) -> Column:
    p = F.lit(True)
    if action != ALL:
        p = p & (F.col("action") == action)
    if role != ALL:
        p = p & (F.col("role") == role)
    return p


def activity_counts(log: DataFrame, actions: Sequence[str] = LOG_ACTIONS) -> DataFrame:
    """F-01: total events and one count per named action, in one aggregate."""
    return log.agg(F.count(F.lit(1)).alias("total_events"),
                   *[F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a in actions])


def activity_view(log: DataFrame, action: str = ALL, role: str = ALL) -> DataFrame:
    """F-02, F-03: conjunctive filter (pushed to the scan), most recent first: the log's own
    order from behind where its rows have a place, else by time."""
    order = [F.col(c).desc() for c in ("pos", "ts", "event_id") if c in log.columns]
    return log.filter(_predicate(action, role)).orderBy(*order)


def activity_footer(log: DataFrame, action: str = ALL, role: str = ALL) -> DataFrame:
    """F-04: "k of n" in one aggregate."""
    return log.agg(F.count_if(_predicate(action, role)).alias("shown"),
                   F.count(F.lit(1)).alias("total")).withColumn(
        "footer", F.format_string("Showing %d of %d events", F.col("shown"), F.col("total")))


def with_log_timestamp(log: DataFrame, ts: str = "ts") -> DataFrame:
    """F-05: the log's text timestamp next to the real one."""
    return log.withColumn("timestamp", F.date_format(F.col(ts), LOG_TIMESTAMP_FORMAT))


def activity_by_action_role(log: DataFrame) -> DataFrame:
    """Counts per (action, role): the filter grid of F-02 in one aggregate."""
    return log.groupBy("action", "role").agg(F.count(F.lit(1)).alias("events"))
