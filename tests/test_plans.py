"""The plans that matter at scale: scans, pushdown, joins, Python workers."""

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from comarca.operators import classify, measures
from comarca.sources.tables import GeoColumns
from comarca.spec import IndicatorSpec
from tools.scans import shape
from workload.registry import QUERIES

GEO = GeoColumns(department="l_linenumber", unit="l_suppkey")


@pytest.fixture(scope="module")
def line(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


@pytest.mark.parametrize("measure,extra", [
    ("__count__", {}), ("mean", {}), ("sum", {}), ("std", {}), ("median", {}), ("mode", {}),
    ("pct_category", {"category": 1}), ("pct_total", {"category": 1})])
def test_value_reference_and_coverage_are_one_scan(line, measure, extra):
    spec = IndicatorSpec(measure=measure, variable="l_quantity" if measure != "__count__"
                         else None, **extra)
    got = shape(measures.indicator_report(line, spec, GEO))
    # a median has read its histogram when it was called, and reads the rows once more at most
    assert got["scans"] == (1 if measure != "median" else min(got["scans"], 1))
    assert got["python"] == 0 and got["nested_loops"] == 0


def test_classes_of_a_computed_result_are_one_scan(line):
    result = measures.indicator(line, IndicatorSpec("unidad", "mean", "l_quantity"), GEO)
    for method in ("equal", "quantile", "stddev", "jenks"):
        got = shape(classify.class_bounds(result, method))
        assert got["scans"] <= 1 and got["python"] == 0, method


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(line):
    spec = IndicatorSpec("unidad", "mean", "l_quantity", department="03")
    text = plan(measures.indicator(line, spec, GEO))
    assert "EqualTo(l_linenumber,3)" in text and "IsNotNull(l_quantity)" in text
    assert "ReadSchema: struct<l_suppkey:bigint,l_linenumber:int,l_quantity:double>" in text
    count = IndicatorSpec("departamento", variable="l_suppkey", category="07")
    assert "EqualTo(l_suppkey,7)" in plan(measures.indicator(line, count, GEO))


def test_count_of_text_category_filters_before_the_shuffle(line):
    spec = IndicatorSpec(variable="l_returnflag", category="R")
    assert "EqualTo(l_returnflag,R)" in plan(measures.indicator(line, spec, GEO))


def test_batch_is_one_scan_and_two_for_medians(line):
    specs = {"a": IndicatorSpec(measure="mean", variable="l_quantity"),
             "b": IndicatorSpec(measure="std", variable="l_tax"),
             "c": IndicatorSpec()}
    assert shape(measures.indicator_batch(line, specs, GEO))["scans"] == 1
    specs |= {f"{m}-{d}": IndicatorSpec(measure=m, variable="l_tax", department=d) for m in ("mean", "sum") for d in (1, 2, 3)}
    got = shape(measures.indicator_batch(line, specs, GEO))
    assert got["scans"] == 1 and got["shuffles"] <= 3    # whatever the number of territories
    specs["d"] = IndicatorSpec(measure="median", variable="l_tax")
    specs["e"] = IndicatorSpec(measure="median", variable="l_quantity")
    assert shape(measures.indicator_batch(line, specs, GEO))["scans"] <= 2    # and the histogram, when it was called


def test_a_median_shuffles_buckets_not_values(spark):
    """Of 200,000 different values of two territories only buckets and a few values move."""
    from pyspark.sql import functions as F
    df = spark.range(0, 200_000, 1, 4).select((F.col("id") % 2).cast("int").alias("idep"), (F.col("id") * 1.5 + 1).alias("v"))
    found = measures.indicator(df, IndicatorSpec(measure="median", variable="v"), GeoColumns(department="idep"))
    assert {r.geo_code: r.valor for r in found.collect()} == {"00": 99_999 * 1.5 + 1, "01": 100_000 * 1.5 + 1}
    moved = written_rows(found)
    assert max(moved) <= 4 * 2 * 32 * 18 and sum(moved) < 40_000


def written_rows(df):
    """Rows that each shuffle of the executed plan wrote."""
    df.collect()
    out, seen = [], set()

    def walk(node):
        if node.id() in seen:
            return
        seen.add(node.id())
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        for inner in ("plan", "executedPlan"):
            if hasattr(node, inner) and node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
                try:
                    walk(getattr(node, inner)())
                except Exception:
                    pass
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_no_registered_query_multiplies_rows_or_leaves_the_jvm(spark, sf_dir):
    for name, fn in QUERIES.items():
        text = plan(fn(spark, sf_dir))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
        assert "Python" not in text and "InPandas" not in text, name
