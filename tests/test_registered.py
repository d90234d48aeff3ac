"""Every registered query against its statement, or at least to its last row."""

import pytest

import __spark_entry__ as entry
from check import compare

QUERIES, STATEMENTS = entry.queries(), entry.oracle_sql()


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, database, folder, name):
    line = compare(spark, database, folder, name, QUERIES[name], STATEMENTS.get(name))
    assert not line.startswith("FAIL"), line


def test_entry(spark, folder):
    df = entry.entry(spark)
    assert df.columns == ["Product", "revenue", "profit"]
    assert df.count() > 0
