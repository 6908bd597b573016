"""Where census tables live and how their columns are found."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from comarca.fixed_values import (
    AREA_COLUMNS, DEPARTMENT_COLUMNS, DEPARTMENT_NAMES, HIDDEN_COLUMNS,
    HIDDEN_SUFFIX, MUNICIPALITY_COLUMNS, PART_FILE_PATTERN, PROVINCE_COLUMNS,
    SHEET_TABLES, TABLE_FILES, TABLE_LABELS, UNIT_COLUMNS,
)
from comarca.functions.codes import pad2


def available_tables(year: int) -> list[tuple[str, str]]:
    """(label, key) of the tables one census has."""
    return [(TABLE_LABELS[t], t) for y, t in TABLE_FILES if y == year]


def dataset_paths(base: str, year: int, table: str,
                  department: str | int | None = None) -> list[str]:
    """Files of a table; one file only when its parts are departments and one is asked."""
    if (year, table) not in TABLE_FILES:
        raise ValueError(f"table {table!r} does not exist for {year}")
    name = TABLE_FILES[(year, table)]
    folder = "fichas" if table in SHEET_TABLES else str(year)
    if "{dep}" not in name:
        return [f"{base}/{folder}/{name}"]
    codes = ([str(department).zfill(2)] if department is not None
             else list(DEPARTMENT_NAMES))
    return [f"{base}/{folder}/{name.format(dep=c)}" for c in codes]


def read_tables(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Many Parquet files as one relation, columns matched by name.

    Files that lack a column give NULL there.  Schemas are merged by Spark while it
    plans the scan, so the result is one scan, not a union of scans.
    """
    return spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths)


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables whose columns differ, stacked by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def part_from_file_name(pattern: str = PART_FILE_PATTERN) -> Column:
    """The part key a file name carries (first group of the pattern).

    Use it inside a ``select``/``withColumn`` directly over a scan: the file name is
    a metadata column of the reader and costs no extra read.
    """
    return F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)


def with_department_from_file(df: DataFrame, column: str = "idep",
                              pattern: str = PART_FILE_PATTERN,
                              universe: Column | None = None) -> DataFrame:
    """Fallback for parts without a department column: take it from the file name.

    Refuses a universe condition, whose totals this path could not vouch for.
    """
    if universe is not None:
        raise ValueError("a table universe needs the department column in the data")
    return df.withColumn(column, pad2(part_from_file_name(pattern)))


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate present, ignoring case; the name as the table spells it."""
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def resolve_columns(df: DataFrame, wanted: dict[str, Sequence[str]],
                    required: Sequence[str] = ()) -> DataFrame:
    """Select columns under their logical names; absent optional ones are NULL text."""
    out = []
    for logical, candidates in wanted.items():
        found = pick_column(df.columns, candidates)
        if found is None and logical in required:
            raise ValueError(f"none of {tuple(candidates)} is a column")
        col = F.col(f"`{found}`") if found else F.lit(None).cast("string")
        out.append(col.alias(logical))
    return df.select(*out)


@dataclass(frozen=True)
class GeoColumns:
    """The columns of a table that place a row in the hierarchy."""

    department: str | None = None
    province: str | None = None
    municipality: str | None = None
    unit: str | None = None
    area: str | None = None

    @classmethod
    def of(cls, df: DataFrame) -> "GeoColumns":
        found = [pick_column(df.columns, c) for c in
                 (DEPARTMENT_COLUMNS, PROVINCE_COLUMNS, MUNICIPALITY_COLUMNS,
                  UNIT_COLUMNS, AREA_COLUMNS)]
        return cls(*found)


def is_hidden(column: str) -> bool:
    """Geographic and technical columns are not variables to analyse."""
    name = column.lower()
    return name in HIDDEN_COLUMNS or name.endswith(HIDDEN_SUFFIX)


def analysis_columns(df: DataFrame) -> list[str]:
    """Columns that can be the variable of an indicator."""
    return [c for c in df.columns if not is_hidden(c)]


def available_levels(df: DataFrame, year: int | None = None,
                     table: str | None = None) -> list[str]:
    """Levels a table can be aggregated to, coarse to fine."""
    if table in SHEET_TABLES:
        return ["unidad"]
    geo = GeoColumns.of(df)
    levels = ["departamento"] if geo.department else []
    if geo.municipality and year != 1976:
        levels.append("municipio")
    return levels
