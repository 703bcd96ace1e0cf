"""Every query runs; those with SQL give DuckDB's rows."""

import pytest
from compare import same

from maskloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), registry.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).columns


def test_entry_imports_and_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
