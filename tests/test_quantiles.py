import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from comarca.operators.quantiles import quantiles

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


def check(spark, groups):
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r.k, r.i): r.q for r in quantiles(df, ["k"], F.col("v"), PROBS).collect()}
    assert len(got) == len(groups) * len(PROBS)
    for k, vs in groups.items():
        want = np.quantile(np.array(vs, float), PROBS)
        for i, w in enumerate(want):
            assert got[(k, i)] == pytest.approx(w, rel=1e-12, abs=1e-12)


def test_shapes(spark):
    rng = np.random.default_rng(7)
    check(spark, {
        None: rng.normal(0, 1e-9, 301), "heavy": rng.pareto(0.5, 500),
        "far": 1.7e15 + rng.integers(0, 1000, 400), "ties": rng.integers(0, 3, 1000),
        "one": [3.5], "two": [-1.0, 1.0], "zero": [0.0, -0.0, 0.0, 5.0],
        "tiny": [5e-324, 1e-310, -5e-324, 1.0], "wide": [-1e308, 1e308, 0.0, 1.0]})


@settings(max_examples=4, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abc"), st.lists(
    st.floats(-1e12, 1e12, allow_nan=False), min_size=1, max_size=40), min_size=1))
def test_any_values(spark, groups):
    check(spark, groups)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", 2.0), ("b", None)], "k string, v double")
    assert [tuple(r) for r in quantiles(df, ["k"], F.col("v"), [0.5]).collect()] == \
        [("a", 0, 2.0)]
    assert quantiles(df.filter("k = 'z'"), [], F.col("v"), [0.5]).collect() == []
    whole = quantiles(df, [], F.col("v"), [0.5]).collect()
    assert [tuple(r) for r in whole] == [(0, 2.0)]


def test_crowded_values_stay_bounded_and_exact(spark):
    crowd = [1000 + i * 1e-11 for i in range(-20_000, 20_001)] + [1020.0, 1e-300, -3.0]
    rows = spark.createDataFrame([("x", v) for v in crowd], "k string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = [r.q for r in quantiles(rows, ["k"], F.col("v"), probs).orderBy("i").collect()]
    want = rows.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).first().q
    assert got == pytest.approx(want, rel=1e-15)
