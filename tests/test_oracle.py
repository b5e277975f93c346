"""Every query with SQL equals DuckDB on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("GRIDWEAVE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    from workload.compare import duck

    return duck(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    from workload.compare import compare

    result = compare(spark, con, name, queries()[name], oracle_sql()[name], SF)
    assert result.startswith("ok"), result


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
