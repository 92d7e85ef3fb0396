import pytest

import __spark_entry__ as entry
from tests.helpers import rows_of, sf_dir, sql_rows
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    df = queries.queries()[name](spark, sf_dir())
    names, want = sql_rows(queries.oracle_sql()[name], sf_dir())
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 11)} <= {name.partition("_")[0] for name in entry.queries()}
    assert "pipeline" in entry.queries() and set(queries.oracle_sql()) <= set(entry.oracle_sql())
