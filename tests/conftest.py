"""One session for all tests, and a comparison of queries with their SQL in DuckDB."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    held = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        held.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return held


def canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with their columns by name, values as text, in order."""
    order = sorted(range(len(names)), key=lambda k: names[k])

    def text(value) -> str:
        if value is None:
            return "\0"
        if isinstance(value, bool):
            return str(value)
        if isinstance(value, float) or type(value).__name__ == "Decimal":
            return f"{float(value):.9g}"
        return str(value)

    return sorted(tuple(text(row[k]) for k in order) for row in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    def check(build, sql: str) -> None:
        df = build(spark, DATA)
        want = duck.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(want.columns, want.fetchall())

    return check
