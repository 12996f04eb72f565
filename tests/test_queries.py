"""Every registered query on the smallest tables, against its SQL."""

import compare
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.oracle(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    found = QUERIES[name](spark, FOLDER)
    if name in ORACLE:
        assert compare.difference(found, con, ORACLE[name]) is None
    else:
        assert found.columns and found.count() >= 0


def test_entry(spark):
    found = driver.entry(spark)
    assert {"orders_expected", "anomaly", "reason"} <= set(found.columns)
    assert found.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
