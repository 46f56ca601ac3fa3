"""Every registered query next to its SQL."""

import pytest
from conftest import SF

import __spark_entry__ as driver
from compare import compare, duck

#: The training-data queries have their own tests.
TEXTS = driver.oracle.queries_sql()
QUERIES = {**driver.batch_queries(), **driver.stream_queries()}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_text_belongs_to_a_query():
    assert set(TEXTS) <= set(QUERIES)
    assert set(QUERIES) == set(TEXTS)


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], TEXTS[name], SF) is None


def test_reports_reach_every_branch(con):
    """Three vehicles in an accident, stops that stay open, both flags in a minute."""
    def count(text, condition):
        return con.sql(f"select count(*) from ({text}) where {condition}").fetchall()[0][0]

    assert count(TEXTS["accident_vehicles"], "involved = 3") > 0
    assert count(TEXTS["stop_intervals"], "t1 is null") > 0
    assert count(TEXTS["segment_accidents"], "t1 is null") > 0
    assert count(TEXTS["accident_flags"], "is_new and is_cleared") > 0


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["kind", "vid", "t", "lav", "toll", "seg", "pos"] and df.count() == 101
