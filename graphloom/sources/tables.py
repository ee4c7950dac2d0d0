"""Tables of a folder of Parquet files, and their types."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from graphloom.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; the columns that a query doesn't use are never read."""
    ship_package(spark)
    return spark.read.parquet(str(PurePosixPath(folder) / f"{name}.parquet") if "://" not in folder else f"{folder}/{name}.parquet")
