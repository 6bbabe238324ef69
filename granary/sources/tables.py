"""Reading the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    """The table ``name`` under ``sf_dir``; only ``columns``, if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
