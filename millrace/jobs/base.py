"""Registration of queries: each has a Spark form and, where SQL can say it, a DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.shared import shared_folder

__all__ = ["Jobs", "shared_folder", "table"]


class Jobs:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Registers the decorated function under its name."""

        def wrap(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
