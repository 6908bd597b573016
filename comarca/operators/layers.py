"""Results joined to names and geometries: what a map layer is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from comarca.fixed_values import AREA_LABELS, DEPARTMENT_NAMES
from comarca.functions.codes import in_department


def department_names(like: DataFrame) -> DataFrame:
    """(geo_code, geo_nombre) of the nine departments."""
    return like.sparkSession.createDataFrame(
        list(DEPARTMENT_NAMES.items()), "geo_code string, geo_nombre string")


def with_names(result: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Result with ``geo_nombre``; a code without a name is shown as itself.

    Without ``names`` (unit level) every code is its own name.
    """
    order = ["geo_code", "geo_nombre"] + [c for c in result.columns if c != "geo_code"]
    if names is None:
        return result.withColumn("geo_nombre", F.col("geo_code")).select(*order)
    one = names.groupBy(F.col("geo_code").alias("_code")).agg(
        F.max("geo_nombre").alias("_name"))
    return (result.join(one, F.col("geo_code") == F.col("_code"), "left")
            .withColumn("geo_nombre", F.coalesce("_name", "geo_code")).select(*order))


def area_layer(features: DataFrame, result: DataFrame, department=None) -> DataFrame:
    """Every area of the geography with its value; NULL where there is no data.

    (geo_code, nombre_geo, valor_censo, casos_censo?, and the feature's other columns).
    """
    if department is not None:
        features = features.filter(in_department(F.col("geo_code"), department))
    values = [F.col("geo_code").alias("_code"), F.col("valor").alias("valor_censo")]
    if "geo_nombre" in result.columns:
        values.append(F.col("geo_nombre").alias("_name"))
    if "casos" in result.columns:
        values.append(F.col("casos").alias("casos_censo"))
    joined = features.join(result.select(*values), F.col("geo_code") == F.col("_code"), "left")
    known = [F.col(c) for c in ("_name", "geo_nombre", "geo_code") if c in joined.columns]
    casos = ["casos_censo"] if "casos" in result.columns else []
    rest = [c for c in features.columns if c not in ("geo_code", "geo_nombre")]
    return joined.select("geo_code", F.coalesce(*known).alias("nombre_geo"),
                         "valor_censo", *casos, *rest)


def unit_layer(units: DataFrame, result: DataFrame) -> DataFrame:
    """Units of one or both areas with value and cases; units without geometry drop out.

    (codigo, nombre_geo, area, valor_censo, casos_censo, geometria): always the same
    columns, so exported tables do not change shape between queries.
    """
    casos = (F.col("casos").cast("double") if "casos" in result.columns
             else F.lit(None).cast("double"))
    values = result.select(F.col("geo_code").alias("_code"),
                           F.col("valor").cast("double").alias("valor_censo"),
                           casos.alias("casos_censo"))
    label: Column = F.col("area")
    for key, text in AREA_LABELS.items():
        label = F.when(F.col("area") == key, F.lit(text)).otherwise(label)
    return (units.filter("geometria IS NOT NULL")
            .join(values, F.col("codigo") == F.col("_code"), "left")
            .select("codigo", F.col("nombre").alias("nombre_geo"), label.alias("area"),
                    "valor_censo", "casos_censo", "geometria"))


def context_area(features: DataFrame, municipality) -> DataFrame:
    """The one area that surrounds a unit map: (nombre_geo, geometria)."""
    return (features.filter(F.col("geo_code") == str(municipality).zfill(6))
            .select(F.coalesce("geo_nombre", "geo_code").alias("nombre_geo"), "geometria"))
