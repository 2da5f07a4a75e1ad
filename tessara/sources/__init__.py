"""Reading tables: Parquet through Spark's own readers, so that columns and filters are pushed down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet files, by any path that Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
