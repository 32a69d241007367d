"""Every query with SQL equals DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle_check

FOLDER = "/root/testdata/sf0.001"
# The whole grid takes minutes on any table, so `python oracle_check.py 0.01 m27` compares it;
# its parts are tested in test_many*.py, test_balls.py and test_study_holds.py.
LONG = {"m27_study"}


@pytest.fixture(scope="module")
def duck():
    return oracle_check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LONG))
def test_query_equals_sql(spark, duck, name):
    ok, note = oracle_check.compare(spark, duck, FOLDER, name)
    assert ok, note


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_one_row(spark):
    assert entry.entry(spark).count() == 1
