"""Every query with a SQL twin gives the same table on both engines."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(base_dir):
    return connect(base_dir)


def test_twins_belong_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in SQL if n != "model_save_load"])
def test_same_as_sql(spark, con, base_dir, name):
    assert differences(QUERIES[name](spark, base_dir), con, SQL[name]) == []


def test_entry_has_rows(spark):
    result = entry.entry(spark)
    assert result.count() > 30
    assert result.columns[0] == "section"
