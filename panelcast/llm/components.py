"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import ensure_checkpoint_dir


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: lineage ends
    there, lost executors cost nothing, and the planner knows the table's size."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every node of ``links(a, b)`` but the roots; a root is its component's least id.

    Each round is a map-side combined minimum and a join per star; the rows
    never exceed the links, and a hot node's links are split by the join.
    """
    e = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                     .where("u <> v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_least(both).withColumn("m", F.least("u", "m")), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = _least(large)
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = written(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select("u", F.col("v").alias("root"))
        state = now
