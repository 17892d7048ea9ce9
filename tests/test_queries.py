"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from glyphlake.plans import registry
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLE.keys()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF_DIR).toPandas()
    assert difference(got, con.sql(registry.ORACLE[name]).df()) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert registry.QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
