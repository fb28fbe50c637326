"""Table sources: Parquet directories and the session's catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, name: str, *, database: bool = False) -> bool:
    """Whether the session's catalogue has a table or view, or a database, of this name."""
    return spark.catalog.databaseExists(name) if database else spark.catalog.tableExists(name)
