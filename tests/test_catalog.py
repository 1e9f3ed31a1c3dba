"""Every named query against its SQL counterpart over the whole small tables."""

import pytest

from diffloom.plans import catalog, oracle
from oracle_check import differences, open_tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, tables, name):
    frame = catalog.QUERIES[name](spark, FOLDER)
    assert differences(frame, tables.sql(oracle.statements()[name])) == []
