"""Writing map layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def feature_text(df: DataFrame, geometry: str = "geometria") -> DataFrame:
    """(value): one GeoJSON Feature per row; ``geometry`` holds its GeoJSON text.

    NULL properties are written as null, so that every feature has the same fields.
    """
    fields = [c for c in df.columns if c not in (geometry, "propiedades")]
    keep_nulls = {"ignoreNullFields": "false"}
    feature: Column = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(*fields).alias("properties"),
        F.parse_json(F.coalesce(F.col(geometry), F.lit("null"))).alias("geometry")),
        keep_nulls)
    return df.select(feature.alias("value"))


def write_features(df: DataFrame, path: str, geometry: str = "geometria",
                   mode: str = "errorifexists") -> None:
    """A folder of GeoJSON features, one per line, written by all tasks."""
    feature_text(df, geometry).write.mode(mode).text(path)


def write_units(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Unit layers as Parquet, one partition per area, geometry as WKB."""
    df.write.mode(mode).partitionBy("area").parquet(path)


#: Rows of a file that ``write_partitioned_by_department`` writes.
ROWS_PER_FILE = 2_000_000


def sized_by_department(df: DataFrame, department: str = "idep", rows_per_file: int = ROWS_PER_FILE,
                        within: Sequence[str] = ("iprov", "imun")) -> DataFrame:
    """``df`` dealt for files of about ``rows_per_file`` rows that each hold one department.

    A department gets as many parts as its rows need, so a large one is written by many
    tasks and a small one is one file.  Codes are integers, and rows are in the order of
    ``within``, so that the statistics in a file rule out other provinces.
    """
    names = {c.lower(): c for c in df.columns}
    codes = [names[c] for c in (department.lower(), *within) if c in names]
    rows = df.withColumns({c: F.col(f"`{c}`").cast("string").try_cast("int") for c in codes})
    own = codes[0]
    parts = rows.groupBy(own).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(rows_per_file))).cast("int").alias("_parts"))
    parts = parts.select(F.col(own).alias("_department"), "_parts")
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col("_parts"))
    dealt = rows.join(parts, F.col(own).eqNullSafe(F.col("_department"))).withColumn("_part", part)
    return (dealt.repartition(own, "_part").sortWithinPartitions(own, *[c for c in codes[1:]])
            .drop("_department", "_parts", "_part"))


def write_partitioned_by_department(df: DataFrame, path: str, department: str = "idep",
                                    mode: str = "errorifexists", rows_per_file: int = ROWS_PER_FILE) -> None:
    """A copy of microdata that department filters prune by folder, in files of bounded size."""
    (sized_by_department(df, department, rows_per_file).write.mode(mode).option("maxRecordsPerFile", rows_per_file)
     .partitionBy(department).parquet(path))
