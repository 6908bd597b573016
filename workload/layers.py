"""Joins of results to names, geometries and surfaces; feature sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from comarca.operators import density as dens
from comarca.operators import layers, measures, quality
from comarca.operators.lineage import checkpoint_folder
from comarca.operators.territory import with_geo_code
from comarca.sources import geometry, sinks
from comarca.spec import IndicatorSpec
from workload import tables as t
from workload.registry import query
from workload.tables import DEP, MUN, with_views

_COUNTED = f"""counted AS (
  SELECT {MUN} AS geo_code, CAST(count(*) AS DOUBLE) AS valor, count(*) AS casos
  FROM residentes GROUP BY 1)"""
_RESULT = with_views("residentes", "areas").rstrip() + ",\n" + _COUNTED + "\n"


def collections(spark, d):
    """One GeoJSON FeatureCollection text per customer, as a source would hold it."""
    rows = t.area_rows(spark, d)
    feature = F.struct(F.lit("Feature").alias("type"),
                       F.struct("idep", "iprov", "imun", "nombre_mun", "superficie_km2")
                       .alias("properties"), F.parse_json("geometria").alias("geometry"))
    whole = F.struct(F.lit("FeatureCollection").alias("type"),
                     F.array(feature).alias("features"))
    return rows.select(F.to_json(whole).alias("value"))


def area_features_of(spark, d):
    return geometry.area_features(collections(spark, d), "municipio")


@query("features_of_large_collections", with_views("areas") + """
SELECT geo_code, geo_nombre, superficie_km2 FROM areas""")
def features_of_large_collections(spark, d):
    """Collections of up to 10,000 features in a text, written as files and read by byte ranges."""
    key = F.get_json_object("value", "$.features[0].properties.idep")
    feature = F.regexp_extract("value", r"^\{\"type\":\"FeatureCollection\",\"features\":\[(.*)\]\}$", 1)
    whole = (collections(spark, d).groupBy(key).agg(F.array_join(F.collect_list(feature), ",\n ").alias("all"))
             .select(F.concat(F.lit('{"type":"FeatureCollection",\n"features":[\n '), "all", F.lit('\n], "bbox": [0, 0, 1, 1]}')).alias("value")))
    path = f"{checkpoint_folder(spark)}/collections-{uuid.uuid4().hex}"
    whole.write.text(path)
    return geometry.read_area_features(spark, path, "municipio", collection=True).select("geo_code", "geo_nombre", "superficie_km2")


def _counted(spark, d):
    return measures.indicator(t.residents(spark, d), IndicatorSpec("municipio"))


@query("geojson_features", with_views("areas") + """
SELECT geo_code, geo_nombre, superficie_km2, geometria FROM areas""")
def geojson_features(spark, d):
    found = area_features_of(spark, d)
    point = F.from_json("geometria", "type string, coordinates array<int>")
    text = F.concat(F.lit('{"type":"'), point["type"], F.lit('","coordinates":['),
                    F.array_join(point["coordinates"].cast("array<string>"), ","), F.lit("]}"))
    return found.select("geo_code", "geo_nombre", "superficie_km2", text.alias("geometria"))


@query("geojson_text_parsed_again", _RESULT + """
SELECT geo_code, geo_nombre AS nombre_geo, valor AS valor_censo,
       CAST(casos AS DOUBLE) AS casos_censo
FROM areas LEFT JOIN counted USING (geo_code)""")
def geojson_text_parsed_again(spark, d):
    layer = layers.area_layer(area_features_of(spark, d), _counted(spark, d))
    back = geometry.parse_features(sinks.feature_text(layer))
    get = lambda name, kind: F.try_variant_get("propiedades", f"$.{name}", kind).alias(name)
    return back.select(get("geo_code", "string"), get("nombre_geo", "string"),
                       get("valor_censo", "double"), get("casos_censo", "double"))


@query("area_layer", _RESULT + """
SELECT geo_code, geo_nombre AS nombre_geo, valor AS valor_censo,
       CAST(casos AS DOUBLE) AS casos_censo, superficie_km2
FROM areas LEFT JOIN counted USING (geo_code) WHERE geo_code LIKE '00%'""")
def area_layer(spark, d):
    layer = layers.area_layer(area_features_of(spark, d), _counted(spark, d), department="0")
    return layer.select("geo_code", "nombre_geo", "valor_censo",
                        F.col("casos_censo").cast("double").alias("casos_censo"),
                        "superficie_km2")


@query("unit_geometry", with_views("unidades") + """
SELECT codigo, nombre, area, hex(encode(geometria)) AS geometria FROM unidades
WHERE idep = 2 AND iprov = 7 AND imun = 1 AND area = 'rural'""")
def unit_geometry(spark, d):
    rows = t.units(spark, d).filter("area = 'rural'").drop("area")
    found = geometry.unit_geometry(rows, "020701", "rural")
    return found.withColumn("geometria", F.hex("geometria"))


@query("unit_layer", with_views("unidades", "fichas") + """
SELECT u.codigo, u.nombre AS nombre_geo,
       CASE u.area WHEN 'urbana' THEN 'Urbana' ELSE 'Rural' END AS area,
       CASE WHEN f.ficha THEN CAST(f.dev_h AS DOUBLE) END AS valor_censo,
       CASE WHEN f.ficha THEN CAST(f.dev_h AS DOUBLE) END AS casos_censo,
       hex(encode(u.geometria)) AS geometria
FROM unidades u LEFT JOIN fichas f ON u.codigo = f.codigo WHERE u.geometria IS NOT NULL""")
def unit_layer(spark, d):
    from comarca.operators.sheets import sheet_indicator
    spec = IndicatorSpec("unidad", "total", "dev_h")
    result = sheet_indicator(t.sheets(spark, d).filter("ficha"), spec, "dev_h")
    layer = layers.unit_layer(t.units(spark, d), result)
    return layer.withColumn("geometria", F.hex("geometria"))


@query("context_area", with_views("areas") + """
SELECT geo_nombre AS nombre_geo, superficie_km2 FROM areas WHERE geo_code = '000042'""")
def context_area(spark, d):
    features = area_features_of(spark, d)
    area = layers.context_area(features, 42)
    return area.join(features.select("superficie_km2", F.col("geo_nombre").alias("nombre_geo")),
                     "nombre_geo").select("nombre_geo", "superficie_km2")


def _supplier_areas(spark, d):
    """Areas of suppliers: customers' territories with a higher number have none."""
    key = F.col("s_suppkey")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(
        F.expr("CAST(s_suppkey div 10000 AS STRING)").alias("idep"), F.expr("s_suppkey div 100 % 100").alias("iprov"),
        (key % 100).alias("imun"), F.col("s_name").alias("nombre_mun")).alias("properties"))
    return geometry.area_features(t.read(spark, d, "supplier").select(F.to_json(feature).alias("value")), "municipio")


_SUPPLIER_CODE = """CASE WHEN s_suppkey >= 1000000
    THEN concat_ws('-', CAST(s_suppkey // 10000 AS VARCHAR), lpad(CAST(s_suppkey // 100 % 100 AS VARCHAR), 2, '0'),
                   lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0')) ELSE lpad(CAST(s_suppkey AS VARCHAR), 6, '0') END"""


@query("codes_without_geometry", _RESULT + f"""
SELECT geo_code, valor, casos FROM counted WHERE geo_code NOT IN (
  SELECT {_SUPPLIER_CODE} FROM supplier)""")
def codes_without_geometry(spark, d):
    return quality.codes_without_geometry(_counted(spark, d), _supplier_areas(spark, d))


@query("codes_with_geometry", _RESULT + f"""
SELECT geo_code, valor, casos FROM counted WHERE geo_code LIKE '00%' AND geo_code IN (
  SELECT {_SUPPLIER_CODE} FROM supplier)""")
def codes_with_geometry(spark, d):
    return quality.codes_with_geometry(_counted(spark, d), _supplier_areas(spark, d), "0")


@query("map_coverage", _RESULT + f"""
SELECT count(*) FILTER (WHERE known) AS mapeados,
       count(*) FILTER (WHERE NOT known) AS sin_geometria
FROM (SELECT geo_code IN (SELECT {_SUPPLIER_CODE} FROM supplier) AS known
      FROM counted)""")
def map_coverage(spark, d):
    return quality.map_coverage(_counted(spark, d), _supplier_areas(spark, d))


@query("geometry_without_data", _RESULT + """
SELECT geo_code, geo_nombre FROM areas
WHERE geo_code NOT IN (SELECT geo_code FROM counted)""")
def geometry_without_data(spark, d):
    found = quality.geometry_without_data(area_features_of(spark, d), _counted(spark, d))
    return found.select("geo_code", "geo_nombre")


@query("surfaces_by_department", with_views("areas") + """
SELECT CASE WHEN geo_code LIKE '%-%' THEN split_part(geo_code, '-', 1) ELSE substr(geo_code, 1, 2) END AS geo_code,
       sum(superficie_km2) AS km2 FROM areas
WHERE superficie_km2 IS NOT NULL GROUP BY 1""")
def surfaces_by_department(spark, d):
    return dens.surfaces(area_features_of(spark, d), "departamento")


@query("density", _RESULT + """
SELECT geo_code, round(valor / superficie_km2, 8) AS valor, casos
FROM counted LEFT JOIN areas USING (geo_code)""")
def density(spark, d):
    surface = dens.surfaces(area_features_of(spark, d))
    found = dens.density(_counted(spark, d), surface, IndicatorSpec("municipio"))
    return found.withColumn("valor", F.round("valor", 8))


@query("reference_density", with_views("residentes", "areas") + """
SELECT round((SELECT count(*) FROM residentes WHERE idep = 0) / sum(superficie_km2), 8)
         AS valor, sum(superficie_km2) AS km2 FROM areas WHERE geo_code LIKE '00%'""")
def reference_density(spark, d):
    spec = IndicatorSpec("municipio", department="00")
    reference = measures.reference_value(t.residents(spark, d), spec)
    surface = dens.surfaces(area_features_of(spark, d))
    found = dens.reference_density(reference, surface, department="0")
    return found.withColumn("valor", F.round("valor", 8))


@query("sources_reconciled", """
WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS geo_code, round(o_totalprice, 2) AS izquierda FROM orders),
b AS (SELECT CAST(l_orderkey AS VARCHAR) AS geo_code,
             round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS derecha
      FROM lineitem GROUP BY 1)
SELECT coalesce(a.geo_code, b.geo_code) AS geo_code, izquierda, derecha,
       round(izquierda - derecha, 2) AS diferencia
FROM a FULL OUTER JOIN b ON a.geo_code = b.geo_code
WHERE coalesce(abs(izquierda - derecha) > 0.01, TRUE)""")
def sources_reconciled(spark, d):
    """Order totals as stored against the sums of their lines."""
    stored = t.read(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("geo_code"), F.round("o_totalprice", 2).alias("valor"))
    lines = t.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("geo_code")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2).alias("valor"))
    gaps = quality.differences(quality.reconcile(stored, lines, tolerance=0.01))
    return gaps.select("geo_code", "izquierda", "derecha", F.round("diferencia", 2).alias("diferencia"))


_LEVEL = """SELECT '{level}' AS nivel, {code} AS geo_code, count(DISTINCT {part}) AS partes,
  CAST(sum(n) FILTER (WHERE {part} IS NOT NULL) AS DOUBLE) AS suma_partes, CAST(sum(n) AS DOUBLE) AS total,
  CAST(sum(n) AS DOUBLE) - CAST(sum(n) FILTER (WHERE {part} IS NOT NULL) AS DOUBLE) AS diferencia FROM p GROUP BY ALL"""


@query("levels_reconciled", f"""
WITH p AS (SELECT n_regionkey AS idep, n_nationkey AS iprov, 1 AS imun, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_custkey END AS codigo,
                  c_custkey % 7 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT 0) """ + " UNION ALL ".join((
    _LEVEL.format(level="total", code="NULL::VARCHAR", part=DEP), _LEVEL.format(level="departamento", code=DEP, part=MUN),
    _LEVEL.format(level="municipio", code=MUN, part="codigo"))))
def levels_reconciled(spark, d):
    """Customers as units of their nation; those of one segment have no unit."""
    rows = t.read(spark, d, "customer").join(t.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("idep"), F.col("n_nationkey").alias("iprov"), F.lit(1).alias("imun"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_custkey")).alias("codigo"), (F.col("c_custkey") % 7).cast("double").alias("n"))
    return quality.levels_reconciled(rows, amount=F.col("n"))


@query("parts_add_up", """
SELECT CAST(count(*) AS DOUBLE) AS suma_partes, CAST(count(*) AS DOUBLE) AS total,
       TRUE AS coincide FROM orders""")
def parts_add_up(spark, d):
    report = measures.indicator_report(t.residents(spark, d), IndicatorSpec("municipio"))
    return quality.parts_and_total(report)


@query("geo_codes_of_layer", with_views("areas") + """
SELECT CASE WHEN geo_code LIKE '%-%' THEN split_part(geo_code, '-', 1) ELSE substr(geo_code, 1, 2) END AS geo_code,
       count(*) AS n FROM areas GROUP BY 1""")
def geo_codes_of_layer(spark, d):
    rows = with_geo_code(t.area_rows(spark, d), "departamento")
    return rows.groupBy("geo_code").agg(F.count(F.lit(1)).alias("n"))
