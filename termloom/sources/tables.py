"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` below ``folder`` (a Parquet file or a folder of them)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def validate_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """``df`` itself; raises ``ValueError`` naming the required columns it lacks."""
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}; there are: {', '.join(df.columns)}")
    return df
