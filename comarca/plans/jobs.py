"""Whole jobs: from a source to a written layer, as submitted to a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from comarca.operators.layers import (
    area_layer, department_names, unit_layer, with_names,
)
from comarca.operators.measures import indicator
from comarca.operators.sheets import sheet_indicator
from comarca.sources.sinks import write_features, write_units
from comarca.sources.tables import dataset_paths, read_tables
from comarca.spec import SHEET_MEASURES, IndicatorSpec, output_name, safe_path_name


def load(spark: SparkSession, base: str, spec: IndicatorSpec) -> DataFrame:
    """The table of a spec; only the asked department's file where files are departments."""
    department = spec.department
    if department is None and spec.municipality is not None:
        department = str(spec.municipality).zfill(6)[:2]
    return read_tables(spark, dataset_paths(base, spec.year, spec.table, department))


def run_indicator(spark: SparkSession, base: str, spec: IndicatorSpec,
                  features: DataFrame, out: str) -> str:
    """Compute an indicator per department or municipality and write its map layer.

    ``features``: (geo_code, geo_nombre, …, geometria).  Returns the written path.
    """
    result = indicator(load(spark, base, spec), spec)
    names = (department_names(result) if spec.level == "departamento"
             else features.select("geo_code", "geo_nombre"))
    layer = area_layer(features, with_names(result, names), spec.department)
    path = f"{out}/{safe_path_name(output_name(spec))}"
    write_features(layer, path)
    return path


def run_unit_indicator(spark: SparkSession, base: str, spec: IndicatorSpec, expr: str,
                       denominator: str | None, units: DataFrame, out: str) -> str:
    """Compute a sheet indicator per unit of a municipality and write its layer by area."""
    if spec.measure not in SHEET_MEASURES or spec.level != "unidad":
        raise ValueError("a unit job computes a sheet measure per unit")
    if spec.municipality is None:
        raise ValueError("units are mapped one municipality at a time")
    result = sheet_indicator(load(spark, base, spec), spec, expr, denominator)
    path = f"{out}/{safe_path_name(output_name(spec))}"
    write_units(unit_layer(units, result), path)
    return path
