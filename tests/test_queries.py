"""Every query against its SQL on the smallest tables; those without SQL run and have rows."""

import pytest

from newsloom import catalog_queries, more_queries, queries, story_queries  # noqa: F401
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, con, name):
    if name in queries.ORACLES:
        oracle.compare(spark, con, sf, queries.QUERIES[name], queries.ORACLES[name])
    else:
        assert queries.QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark, sf):
    """First row of a group without sorting whole groups, pushed filters, pruned columns, bounded sorts."""
    first = plan(queries.QUERIES["W1_first_per_story"](spark, sf))
    assert "WindowGroupLimit" in first and "props" not in first.split("== Physical Plan ==")[1]
    keyset = plan(queries.QUERIES["T2_keyset"](spark, sf))
    assert "TakeOrderedAndProject" in keyset and "PushedFilters: [Or(" in keyset
    assert "Cartesian" not in plan(queries.QUERIES["J9_near_in_time"](spark, sf))
