import pytest

import __spark_entry__ as entry
from tests.oracle import SMALL, assert_same
from tidewire.plans import registered


@pytest.mark.parametrize("name", sorted(registered.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(registered.QUERIES[name](spark, SMALL), registered.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registered.QUERIES) - set(registered.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert registered.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).filter("row_total = 1 and col_total = 1").count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
