"""Surfaces and densities: a value already aggregated, divided by its territory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from comarca.functions.codes import department_of, in_department
from comarca.spec import IndicatorSpec


def surfaces(areas: DataFrame, level: str = "municipio") -> DataFrame:
    """(geo_code, km2) from municipal areas (geo_code, superficie_km2).

    A department's surface is the sum of its municipalities'.  Areas without a
    declared surface are left out.
    """
    rows = areas.filter("superficie_km2 IS NOT NULL")
    code = department_of(F.col("geo_code")) if level == "departamento" else F.col("geo_code")
    return rows.groupBy(code.alias("geo_code")).agg(
        F.sum(F.col("superficie_km2").cast("double")).alias("km2"))


def density(result: DataFrame, surface: DataFrame, spec: IndicatorSpec | None = None
            ) -> DataFrame:
    """The result per km²; NULL where no surface is known."""
    if spec is not None and not spec.can_be_density():
        raise ValueError("a density needs a count or a sum per department or municipality")
    km2 = surface.select(F.col("geo_code").alias("_code"), "km2")
    return (result.join(km2, F.col("geo_code") == F.col("_code"), "left")
            .withColumn("valor", F.try_divide(F.col("valor"), F.col("km2")))
            .select(*result.columns))


def reference_density(reference: DataFrame, surface: DataFrame, department=None,
                      municipality=None) -> DataFrame:
    """The reference value per km² of the territory that bounds it; NULL on no surface."""
    rows = surface
    if municipality is not None:
        rows = rows.filter(F.col("geo_code") == str(municipality).zfill(6))
    elif department is not None:
        rows = rows.filter(in_department(F.col("geo_code"), department))
    km2 = rows.agg(F.sum("km2").alias("km2")).scalar()
    return reference.select(F.try_divide(F.col("valor"), km2).alias("valor"),
                            km2.alias("km2"))
