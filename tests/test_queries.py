import pytest

import __spark_entry__ as entry
from tariffgrid.queries import ORACLES, QUERIES
from tests.oracle import duck, rows_of, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    names, rows = spark_rows(QUERIES[name](spark, SF))
    assert rows, "a query without rows proves nothing"
    assert (names, rows) == rows_of(con, ORACLES[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).head(1)


def test_every_catalog_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
