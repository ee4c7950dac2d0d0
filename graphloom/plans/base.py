"""A registry of queries, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.graph import in_force
from graphloom.session import checkpoint_folder
from graphloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

# The row in force of each id, in SQL.
NOW = """now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, coalesce(end_line, -1) DESC, coalesce(docstring, '') DESC) AS rn
FROM nodes WHERE id IS NOT NULL) WHERE rn = 1)"""
PATHS = "paths AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL)"


class Tables:
    """The tables of a folder, read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        checkpoint_folder(spark)
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name == "now":
            return in_force(self.nodes)
        return table(self.spark, self.folder, name)


class Registry:
    def __init__(self) -> None:
        self.functions: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):  # noqa: ANN201
        """Register a function of Tables under its name, with its SQL if there is one."""

        def take(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.functions[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return take
