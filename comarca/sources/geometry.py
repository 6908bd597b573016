"""Geometry tables: GeoJSON features and WKB units.  Geometry is carried, never computed."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from comarca.fixed_values import (
    AREAS, BLOCK_GEOMETRY_FILE, COMMUNITY_GEOMETRY_FILE,
)
from comarca.functions.codes import int_code, joined_parts


def unit_geometry_path(base: str, area: str, department) -> str:
    """File of unit geometries: one per department for blocks, one for communities."""
    if area not in AREAS:
        raise ValueError(f"unknown area {area!r}")
    name = (COMMUNITY_GEOMETRY_FILE if area == "rural"
            else BLOCK_GEOMETRY_FILE.format(dep=str(department).zfill(2)))
    return f"{base}/fichas/{name}"


def unit_geometry(df: DataFrame, municipality, area: str) -> DataFrame:
    """(codigo, nombre, area, geometria) of the units of one municipality."""
    if area not in AREAS:
        raise ValueError(f"unknown area {area!r}")
    code = str(municipality).zfill(6)
    for column, part in (("idep", code[:2]), ("iprov", code[2:4]), ("imun", code[4:6])):
        df = df.filter(int_code(df, column) == F.lit(int(part)))
    return df.select(F.col("codigo").cast("string").alias("codigo"),
                     F.coalesce(F.col("nombre").cast("string"), F.lit("")).alias("nombre"),
                     F.lit(area).alias("area"), "geometria")


def read_unit_geometry(spark: SparkSession, base: str, municipality,
                       area: str) -> DataFrame:
    """The units of a municipality from the published files of its area."""
    path = unit_geometry_path(base, area, str(municipality).zfill(6)[:2])
    return unit_geometry(spark.read.parquet(path), municipality, area)


def parse_features(df: DataFrame, text: str = "value") -> DataFrame:
    """(propiedades, geometria): features of GeoJSON texts.

    A text is a FeatureCollection or one Feature (the line-per-feature layout, which
    is the one that splits over tasks).  Properties stay a variant; geometry is its
    JSON text, whatever its nesting.
    """
    doc = df.select(F.parse_json(F.col(text)).alias("doc"))
    many = F.try_variant_get("doc", "$.features", "array<variant>")
    feature = doc.select(F.explode(F.coalesce(many, F.array(F.col("doc")))).alias("f"))
    return feature.select(F.try_variant_get("f", "$.properties", "variant").alias("propiedades"),
                          F.to_json(F.try_variant_get("f", "$.geometry", "variant"))
                          .alias("geometria"))


def _property(name: str) -> Column:
    return F.try_variant_get("propiedades", f"$.{name}", "string")


def area_features(df: DataFrame, level: str, text: str = "value") -> DataFrame:
    """(geo_code, geo_nombre, superficie_km2, propiedades, geometria) of area features."""
    part = lambda c: F.trim(F.coalesce(_property(c), F.lit("")))
    names = ["idep"] if level == "departamento" else ["idep", "iprov", "imun"]
    code = joined_parts([part(c) for c in names])
    name = _property("nombre_dep" if level == "departamento" else "nombre_mun")
    return parse_features(df, text).select(
        code.alias("geo_code"), F.when(name != "", name).alias("geo_nombre"),
        F.try_variant_get("propiedades", "$.superficie_km2", "double")
        .alias("superficie_km2"), F.to_json("propiedades").alias("propiedades"), "geometria")


def read_area_features(spark: SparkSession, path: str, level: str,
                       whole_file: bool = False, collection: bool = False) -> DataFrame:
    """Area features of a GeoJSON file: a feature per line; with ``collection``, of collections
    that are read in parallel; with ``whole_file``, of one that a single task reads."""
    texts = read_feature_collections(spark, path) if collection else spark.read.text(path, wholetext=whole_file)
    return area_features(texts, level)


#: So much of a file is looked at for how its features begin.
HEAD_BYTES = 1 << 20
_FEATURE_START = re.compile(r'\{\s*"type"\s*:\s*"Feature"\s*,')


def _feature_starts(spark: SparkSession, path: str) -> dict[str | None, list[str]]:
    """Files of ``path`` (a file, a folder or a pattern) by the text their features begin with."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str | None, list[str]] = {}
    todo = list(files.globStatus(at) or ())
    if not todo:
        raise FileNotFoundError(path)
    while todo:
        one = todo.pop()
        if one.getPath().getName().startswith(("_", ".")):
            continue
        if one.isDirectory():
            todo += list(files.listStatus(one.getPath()))
            continue
        stream = files.open(one.getPath())
        try:
            head = bytes(stream.readNBytes(HEAD_BYTES)).decode("utf-8", "replace")
        finally:
            stream.close()
        start = _FEATURE_START.search(head)
        found.setdefault(start.group() if start else None, []).append(one.getPath().toString())
    return found


def read_feature_collections(spark: SparkSession, path: str) -> DataFrame:
    """(value): texts of whole features out of GeoJSON collections of any size, for ``parse_features``.

    Files are cut at the text their features begin with (``{"type": "Feature",`` in the
    file's own spacing), which no string in JSON can hold, so every task reads its own range
    of bytes.  Features written with another spacing than the first stay with the one before
    them and are found when the text is parsed.  A file whose features begin with another
    key is read whole, in one task.  A text that is no JSON is an error when it is parsed.
    """
    parts = []
    for start, files in sorted(_feature_starts(spark, path).items(), key=lambda x: x[0] or ""):
        if start is None:
            parts.append(spark.read.text(files, wholetext=True).filter(F.trim("value") != ""))
            continue
        cut = spark.read.option("lineSep", start).text(files)
        # the rest of a feature begins with a key; what begins with a brace comes before the first
        rest = cut.filter(~F.col("value").rlike(r"^[\s\x{FEFF}]*(\{|\[|$)"))
        parts.append(rest.select(F.concat(F.lit('{"features":[' + start), F.regexp_replace("value", r",\s*$", ""), F.lit("]}"))
                                 .alias("value")))
    return reduce(DataFrame.union, parts)


def area_names(features: DataFrame) -> DataFrame:
    """(geo_code, geo_nombre) of the named areas."""
    return features.filter("geo_nombre IS NOT NULL").select("geo_code", "geo_nombre")
