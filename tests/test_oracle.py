"""Every query of the library against its SQL."""

import pytest

import __spark_entry__ as driver
from tools.check_oracle import compare, connect
from workload.registry import ORACLE, QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, sf_dir):
    problem = compare(spark, con, sf_dir, QUERIES[name], ORACLE[name])
    assert problem is None


def test_entry(spark):
    assert driver.entry(spark).count() > 1
