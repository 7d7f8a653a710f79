"""Every query with an SQL form gives the rows of that SQL on the given tables."""

import pytest
from oracle import DATA, connect, difference

import __spark_entry__ as registry

FOLDER = DATA / "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, str(FOLDER))
    assert difference(df, con, registry.oracle_sql()[name]) is None


def test_entry_runs(spark):
    assert registry.entry(spark).count() == 20
