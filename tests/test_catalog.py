import pytest

import __spark_entry__ as entry
from tests.helpers import rows_of, sf_dir, sql_rows
from tidemark import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, name):
    df = catalog.queries()[name](spark, sf_dir())
    names, want = sql_rows(SQL[name], sf_dir())
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_every_market_query_has_sql():
    assert set(catalog.queries()) == set(SQL)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
