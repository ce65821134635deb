"""Every checked query against SQL in DuckDB on the smallest test data."""

import pytest

from checks.compare import connect, difference
from checks.oracle import ORACLE
from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert difference(df, duck.sql(ORACLE[name])) is None


def test_every_sql_has_a_query():
    assert set(ORACLE) == set(QUERIES)
