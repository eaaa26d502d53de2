"""Reading the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table; only the columns a plan uses are read from its files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
