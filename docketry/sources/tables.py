"""Parquet table access by name, with column pruning stated at the read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.session import ship


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; with ``columns``, only those are read."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
