"""Every registered query against its SQL on the same tables."""

import pytest

from perievent.operators import registry
from tests.same import assert_same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    rel = duck.sql(registry.SQL[name])
    assert_same(df.columns, [tuple(r) for r in df.collect()], rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry_module():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
