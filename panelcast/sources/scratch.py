"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from panelcast.session import ensure_checkpoint_dir


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table: lineage ends there, a lost executor costs nothing, and
    the planner knows the table's size. The folder goes when the driver's file system closes."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
