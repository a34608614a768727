"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(path: str) -> str:
    """The path as a pattern: the streaming file source takes a single file only by a pattern."""
    return f"{path[:-1]}[{path[-1]}]"
