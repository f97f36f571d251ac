"""Readers for the given parquet tables and for user files (A-01)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; only the columns a plan uses are read (parquet pruning)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_sales_file(spark: SparkSession, path: str, fmt: str | None = None,
                    schema: StructType | None = None) -> DataFrame:
    """A-01: a user table with a header; CSV types are inferred unless a schema is given.

    CSV inference costs one extra pass over the file; pass ``schema`` for
    large inputs. Parquet/ORC/JSON go through the same call.
    """
    fmt = fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower() or "parquet"
    if fmt == "csv":
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(fmt).load(path)
