"""Activity counts over a stream of log entries (F-01/F-02 on readStream).

The batch operators in ``panelcast.operators.activity`` are plain
expressions; here they run as a Structured Streaming aggregation with a
watermark, so late entries are bounded and state is dropped after the
event-time window closes. Checkpoints go under the shared checkpoint
folder the session names.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelcast.operators.activity import LOG_ACTIONS
from panelcast.sources.activity_log import LOG_SCHEMA
from panelcast.session import ensure_checkpoint_dir


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    from panelcast.operators.activity import LOG_TIMESTAMP_FORMAT
    return (spark.readStream.schema(LOG_SCHEMA).json(path)
            .withColumn("ts", F.try_to_timestamp(F.col("timestamp"), F.lit(LOG_TIMESTAMP_FORMAT))))


def windowed_counts(log: DataFrame, window: str = "1 hour", watermark: str = "1 day",
                    actions=LOG_ACTIONS) -> DataFrame:
    """Per event-time window and role: total and per-action counts."""
    return (log.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window), "role")
            .agg(F.count(F.lit(1)).alias("total_events"),
                 *[F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a in actions]))


def start_counts(spark: SparkSession, source: str, sink: str, name: str = "activity_counts",
                 available_now: bool = False, **kw) -> StreamingQuery:
    """Run ``windowed_counts`` from JSON files in ``source`` to parquet in ``sink``.

    The stream's checkpoint lives under the shared checkpoint folder, so a
    restarted driver resumes where it stopped. ``available_now`` processes
    what is there and stops (a bounded catch-up run).
    """
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    writer = (windowed_counts(read_log_stream(spark, source), **kw)
              .writeStream.outputMode("append").format("parquet")
              .option("path", sink).option("checkpointLocation", ckpt))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
