"""Registration of queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The clock of all queries.
NOW = "2024-01-15 12:00:00"


class Tables:
    """The tables of a folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under the name, with its SQL if it has one."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return register


def work_folder(t: Tables, name: str) -> str:
    """A new folder in the one that all executors share."""
    return sinks.work_folder(t.spark, name)
