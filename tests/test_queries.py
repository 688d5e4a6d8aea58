import pytest
from oracle import assert_same

from tessera.plans import registry

ENTRIES = registry.entries()


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if sql])
def test_against_sql(spark, sf_dir, name):
    query, sql = ENTRIES[name]
    assert_same(query(spark, sf_dir), sf_dir, sql)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if not sql])
def test_runs(spark, sf_dir, name):
    assert ENTRIES[name][0](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
