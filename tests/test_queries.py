"""Every registered query of the library proper against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
from atomweave.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalogue.QUERIES, catalogue.ORACLE


@pytest.fixture(scope="module")
def database():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    problem, count, *_ = compare.check(spark, SF, name, QUERIES[name], ORACLE.get(name), database)
    assert problem is None
    assert count > 0


def test_entry(spark):
    assert QUERIES.items() <= entry.queries().items() and ORACLE.items() <= entry.oracle_sql().items()
    assert entry.entry(spark).count() == 10
