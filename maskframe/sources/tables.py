"""Parquet scan of one of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """``base/name.parquet``, a file or a directory of files."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
