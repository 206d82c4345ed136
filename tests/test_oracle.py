"""Every query with an SQL form gives the same rows in both engines."""

import pytest

import __spark_entry__ as entry_module
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    problem, _ = compare(spark, con, SF, entry_module.queries()[name], entry_module.oracle_sql()[name])
    assert problem is None, problem


def test_entry_runs(spark):
    assert entry_module.entry(spark).columns == [
        "date", "title", "trend", "sentiment", "url", "search_range", "page_num",
    ]
