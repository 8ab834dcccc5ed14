"""Every query with SQL gives the SQL's rows; every other one runs."""

from __future__ import annotations

import pytest

from corvane.plans import registry
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark):
    df = registry.QUERIES[name](spark, DATA)
    assert df.schema == df.schema and len(df.columns) == len(set(df.columns))
    df.count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
