"""Queries that have SQL against it; all of them registered."""

import pytest

import __spark_entry__ as driver
from comarca.llm.queries import ORACLE, QUERIES
from tools.check_oracle import compare, connect


def test_all_operators_and_the_pipeline_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(name, spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, QUERIES[name], ORACLE[name]) is None
