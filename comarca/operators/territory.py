"""Territories: deriving, normalising and filtering geographic codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from comarca.fixed_values import AREAS
from comarca.functions.codes import in_department, int_code, joined_parts, pad2, zero_fill
from comarca.sources.tables import GeoColumns
from comarca.spec import IndicatorSpec

CODE_WIDTH = {"departamento": 2, "municipio": 6, "unidad": 0}


def geo_code(level: str, geo: GeoColumns) -> Column:
    """The code of a row at a level.

    Departments are two digits; municipalities three parts of two digits (longer parts
    stay whole, with borders between), or the bare municipality column where there is no
    other; units keep their own code.
    A row with a missing part has no code (NULL), and is its own group.
    """
    if level == "unidad":
        if not geo.unit:
            raise ValueError("the table has no census-unit column")
        return F.col(f"`{geo.unit}`").cast("string")
    if level == "departamento":
        if not geo.department:
            raise ValueError("the table has no department column")
        return pad2(F.col(f"`{geo.department}`"))
    if geo.department and geo.province and geo.municipality:
        parts = (geo.department, geo.province, geo.municipality)
        return joined_parts([F.col(f"`{c}`") for c in parts])
    if geo.municipality:
        return normalize_geo_code(F.col(f"`{geo.municipality}`").cast("string"), level)
    raise ValueError("the table has no municipality columns")


def source_columns(level: str, geo: GeoColumns) -> list[str]:
    """Columns the code of a level is made of (the cheap key to pre-aggregate on)."""
    if level == "unidad":
        names = [geo.unit]
    elif level == "departamento":
        names = [geo.department]
    elif geo.department and geo.province and geo.municipality:
        names = [geo.department, geo.province, geo.municipality]
    else:
        names = [geo.municipality]
    if None in names:
        geo_code(level, geo)          # raises with the right message
    return names


def normalize_geo_code(code: Column, level: str) -> Column:
    """The code filled with zeros to the width of its level; never truncated."""
    width = CODE_WIDTH[level]
    return zero_fill(code, width) if width else code


def with_geo_code(df: DataFrame, level: str, geo: GeoColumns | None = None) -> DataFrame:
    """The table with a ``geo_code`` column for the level."""
    return df.withColumn("geo_code", geo_code(level, geo or GeoColumns.of(df)))


def territory_condition(df: DataFrame, department=None, municipality=None, area=None,
                        geo: GeoColumns | None = None, ignore_missing: bool = False) -> list[tuple[str, Column]]:
    """What ``filter_territory`` asks of a row: (column, condition on it) for each column."""
    geo = geo or GeoColumns.of(df)
    asked = []
    if municipality is not None:
        code = str(municipality).strip().zfill(6)
        parts = zip((geo.department, geo.province, geo.municipality),
                    (code[:2], code[2:4], code[4:6]))
        for column, value in parts:
            if column is None:
                raise ValueError("a municipality filter needs department, province "
                                 "and municipality columns")
            asked.append((column, int_code(df, column) == F.lit(int(value))))
    elif department is not None and not geo.department:
        if not ignore_missing:
            raise ValueError("a department filter needs a department column")
    elif department is not None:
        asked.append((geo.department, int_code(df, geo.department) == F.lit(int(str(department)))))
    if area is not None:
        if str(area).lower() not in AREAS:
            raise ValueError(f"unknown area {area!r}")
        if not geo.area and not ignore_missing:
            raise ValueError("an area filter needs an area column")
        if geo.area:
            asked.append((geo.area, int_code(df, geo.area) == F.lit(AREAS[str(area).lower()])))
    return asked


def filter_territory(df: DataFrame, department=None, municipality=None, area=None,
                     geo: GeoColumns | None = None, ignore_missing: bool = False) -> DataFrame:
    """Rows of one department or one municipality, and of one area.

    Codes compare as integers, so ``'3'``, ``'03'`` and ``3`` are one code.  A
    municipality replaces the department and needs all three columns.  A department or
    area filter on a table without that column is an error; with ``ignore_missing`` it
    has no effect.
    """
    for _, condition in territory_condition(df, department, municipality, area, geo, ignore_missing):
        df = df.filter(condition)
    return df


def scope(df: DataFrame, spec: IndicatorSpec, geo: GeoColumns | None = None,
          universe: Column | None = None) -> DataFrame:
    """The rows an indicator is computed on: table universe first, then territory."""
    from comarca.operators.universe import apply_universe
    if universe is not None:
        df = df.filter(universe)
    else:
        df = apply_universe(df, spec.year, spec.table)
    return filter_territory(df, spec.department, spec.municipality, spec.area, geo)


def municipalities_of(names: DataFrame, department) -> DataFrame:
    """Municipalities of one department, by name (``names``: geo_code, geo_nombre)."""
    return (names.filter(in_department(F.col("geo_code"), department))
            .select("geo_nombre", "geo_code").orderBy("geo_nombre", "geo_code"))
