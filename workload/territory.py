"""Scans, columns, territories, universes and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from comarca.functions.codes import (
    category_eq, category_order, category_sort_keys, normalize_code,
)
from comarca.operators import territory, universe
from comarca.operators.measures import coverage
from comarca.sources import tables as src
from comarca.sources.dictionaries import read_dictionary
from comarca.sources.tables import GeoColumns
from workload import tables as t
from workload.registry import query
from workload.tables import DEP, MUN, with_views


@query("scan_many_files", """
SELECT parte, count(*) AS filas, count(o) AS con_pedido, count(l) AS con_linea FROM (
  SELECT 'orders' AS parte, o_orderkey AS o, NULL AS l FROM orders
  UNION ALL SELECT 'lineitem', NULL, l_orderkey FROM lineitem) GROUP BY parte""")
def scan_many_files(spark, d):
    both = src.read_tables(spark, [f"{d}/orders.parquet", f"{d}/lineitem.parquet"])
    part = src.part_from_file_name(r"([a-z]+)\.parquet").alias("parte")
    return both.select(part, "o_orderkey", "l_orderkey").groupBy("parte").agg(
        F.count(F.lit(1)).alias("filas"), F.count("o_orderkey").alias("con_pedido"),
        F.count("l_orderkey").alias("con_linea"))


@query("department_from_file_name", """
SELECT 'st' AS idep, count(*) AS filas, round(sum(c_acctbal), 2) AS saldo FROM customer""")
def department_from_file_name(spark, d):
    rows = src.with_department_from_file(src.read_tables(spark, [f"{d}/customer.parquet"]),
                                         pattern=r"cu(st)omer")
    return rows.groupBy("idep").agg(F.count(F.lit(1)).alias("filas"),
                                    F.round(F.sum("c_acctbal"), 2).alias("saldo"))


@query("logical_columns_union", """
SELECT nacion, count(*) AS filas, count(segmento) AS con_segmento,
       round(sum(saldo), 2) AS saldo FROM (
  SELECT c_nationkey AS nacion, c_mktsegment AS segmento, c_acctbal AS saldo FROM customer
  UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier) GROUP BY nacion""")
def logical_columns_union(spark, d):
    wanted = {"nacion": ("N_NATIONKEY", "C_NATIONKEY", "S_NATIONKEY"),
              "saldo": ("c_acctbal", "s_acctbal"), "segmento": ("c_mktsegment",)}
    parts = [src.resolve_columns(t.read(spark, d, n), wanted, required=["nacion", "saldo"])
             for n in ("customer", "supplier")]
    return src.union_by_name(parts).groupBy("nacion").agg(
        F.count(F.lit(1)).alias("filas"), F.count("segmento").alias("con_segmento"),
        F.round(F.sum("saldo"), 2).alias("saldo"))


@query("column_listing", with_views("personas") + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) AS n_total, count({c}) AS n_valid FROM personas"
    for c in ("persona", "prioridad", "prioridad_num", "segmento", "v01_tipoviv",
              "edad", "ingreso", "agro", "anios_texto", "hijos")))
def column_listing(spark, d):
    people = t.persons(spark, d).drop("estado_txt")
    return coverage(people, src.analysis_columns(people))


_DEPARTMENTS, _MUNICIPALITIES = (
    f"""SELECT '{{0}}' AS tabla, '{level}' AS nivel, {code} AS geo_code, count(*) AS n FROM {{0}} GROUP BY ALL"""
    for level, code in (("departamento", DEP), ("municipio", MUN)))


@query("levels_of_tables", with_views("personas", "residentes") + " UNION ALL ".join(
    level.format(table) for table in ("personas", "residentes") for level in (_DEPARTMENTS, _MUNICIPALITIES)))
def levels_of_tables(spark, d):
    """Rows per territory at every level that a table has."""
    rows = [territory.with_geo_code(df, level).groupBy("geo_code").agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(name).alias("tabla"), F.lit(level).alias("nivel"), "geo_code", "n")
            for name, df in (("personas", t.persons(spark, d)), ("residentes", t.residents(spark, d)))
            for level in src.available_levels(df)]
    return src.union_by_name(rows)


@query("dictionary_read", """
SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type""")
def dictionary_read(spark, d):
    rows = read_dictionary(spark, f"{d}/part.parquet", ["p_brand", "p_type"])
    return rows.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


def _count_codes(df):
    return df.groupBy("geo_code").agg(F.count(F.lit(1)).alias("n"))


@query("geo_code_department", with_views("personas") + f"""
SELECT {DEP} AS geo_code, count(*) AS n FROM personas GROUP BY 1""")
def geo_code_department(spark, d):
    return _count_codes(territory.with_geo_code(t.persons(spark, d), "departamento"))


@query("geo_code_municipality", with_views("personas") + f"""
SELECT {MUN} AS geo_code, count(*) AS n FROM personas GROUP BY 1""")
def geo_code_municipality(spark, d):
    return _count_codes(territory.with_geo_code(t.persons(spark, d), "municipio"))


@query("geo_code_unit", """
SELECT CAST(l_suppkey AS VARCHAR) AS geo_code, count(*) AS n FROM lineitem GROUP BY 1""")
def geo_code_unit(spark, d):
    geo = GeoColumns(unit="l_suppkey")
    return _count_codes(territory.with_geo_code(t.read(spark, d, "lineitem"), "unidad", geo))


@query("geo_code_bare_municipality", """
SELECT CASE WHEN o_custkey % 3 = 0 THEN NULL
            WHEN o_custkey % 3 = 1 THEN lpad(CAST(o_custkey AS VARCHAR), 6, '0')
            ELSE '-' || lpad(CAST(o_custkey AS VARCHAR), 5, '0') END AS geo_code,
       count(*) AS n FROM orders GROUP BY 1""")
def geo_code_bare_municipality(spark, d):
    key = F.col("o_custkey")
    code = F.when(key % 3 == 1, key).when(key % 3 == 2, -key)
    rows = t.read(spark, d, "orders").select(code.alias("MUN"))
    return _count_codes(territory.with_geo_code(rows, "municipio"))


@query("normalized_geo_code", """
SELECT CASE WHEN length(CAST(l_partkey AS VARCHAR)) < 6
            THEN lpad(CAST(l_partkey AS VARCHAR), 6, '0')
            ELSE CAST(l_partkey AS VARCHAR) END AS geo_code, count(*) AS n
FROM lineitem GROUP BY 1""")
def normalized_geo_code(spark, d):
    code = territory.normalize_geo_code(F.col("l_partkey").cast("string"), "municipio")
    return _count_codes(t.read(spark, d, "lineitem").select(code.alias("geo_code")))


@query("filter_municipality", with_views("personas") + f"""
SELECT {MUN} AS geo_code, count(*) AS n, round(sum(ingreso), 2) AS ingreso
FROM personas WHERE idep = 2 AND iprov = 7 AND imun = 1 GROUP BY 1""")
def filter_municipality(spark, d):
    rows = territory.filter_territory(t.persons(spark, d), department="4",
                                      municipality="020701")
    return territory.with_geo_code(rows, "municipio").groupBy("geo_code").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("ingreso"), 2).alias("ingreso"))


@query("filter_department_and_area", with_views("fichas") + f"""
SELECT {MUN} AS geo_code, count(*) AS unidades, CAST(sum(personas) AS BIGINT) AS personas
FROM fichas WHERE idep = 3 AND area = 2 GROUP BY 1""")
def filter_department_and_area(spark, d):
    rows = territory.filter_territory(t.sheets(spark, d), department="03", area="rural")
    return territory.with_geo_code(rows, "municipio").groupBy("geo_code").agg(
        F.count(F.lit(1)).alias("unidades"), F.sum("personas").alias("personas"))


@query("filter_padded_text_codes", with_views("personas") + """
SELECT v01_tipoviv AS estado, count(*) AS n FROM personas WHERE v01_tipoviv = 2 GROUP BY 1""")
def filter_padded_text_codes(spark, d):
    rows = territory.filter_territory(t.persons(spark, d), department=2,
                                      geo=GeoColumns(department="estado_txt"))
    return rows.groupBy(F.col("v01_tipoviv").alias("estado")).agg(
        F.count(F.lit(1)).alias("n"))


@query("universe_filter", with_views("personas") + f"""
SELECT {DEP} AS geo_code, count(*) AS n FROM personas
WHERE v01_tipoviv NOT IN (3, 15) GROUP BY 1""")
def universe_filter(spark, d):
    rows = t.persons(spark, d)
    rows = rows.filter(universe.not_in_codes(rows, "estado_txt", [3, 15]))
    return _count_codes(territory.with_geo_code(rows, "departamento"))


@query("universe_of_table", """
SELECT count(*) AS n, count(DISTINCT o_custkey) AS clientes FROM orders
WHERE o_orderkey % 20 NOT IN (15, 16)""")
def universe_of_table(spark, d):
    rows = t.read(spark, d, "orders").withColumn(
        "V01_TIPOVIV", (F.col("o_orderkey") % 20).cast("string"))
    return universe.apply_universe(rows, 2024, "viviendas").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("clientes"))


@query("dwelling_kinds", """
SELECT CASE WHEN k BETWEEN 1 AND 6 THEN 'particular' WHEN k BETWEEN 7 AND 14
            THEN 'colectiva' WHEN k IN (15, 16) THEN 'no_vivienda' END AS clase,
       count(*) AS n FROM (SELECT o_orderkey % 20 AS k FROM orders) GROUP BY 1""")
def dwelling_kinds(spark, d):
    rows = t.read(spark, d, "orders").select((F.col("o_orderkey") % 20).alias("v01_tipoviv"))
    return rows.groupBy(universe.dwelling_kind(rows, 2024).alias("clase")).agg(
        F.count(F.lit(1)).alias("n"))


@query("universe_impact", with_views("personas") + """
SELECT idep, count(*) AS n_crudo, count(*) FILTER (WHERE v01_tipoviv <> 3) AS n_universo,
       count(*) FILTER (WHERE v01_tipoviv = 3) AS n_fuera FROM personas GROUP BY idep""")
def universe_impact(spark, d):
    rows = t.persons(spark, d)
    return universe.universe_impact(rows, universe.not_in_codes(rows, "v01_tipoviv", [3]),
                                    ["idep"])


@query("category_predicate", with_views("personas") + """
SELECT segmento, count(*) FILTER (WHERE prioridad_num = 2) AS n_codigo,
       count(*) FILTER (WHERE segmento = 'BUILDING') AS n_texto
FROM personas GROUP BY segmento""")
def category_predicate(spark, d):
    rows = t.persons(spark, d)
    return rows.groupBy("segmento").agg(
        F.count_if(category_eq(rows, "prioridad", " 02 ")).alias("n_codigo"),
        F.count_if(category_eq(rows, "segmento", "BUILDING")).alias("n_texto"))


@query("normalized_codes", with_views("personas") + """
SELECT codigo, count(*) AS n FROM (
  SELECT CAST(prioridad_num AS VARCHAR) AS codigo FROM personas
  UNION ALL SELECT segmento FROM personas
  UNION ALL SELECT CAST(-edad AS VARCHAR) FROM personas) GROUP BY codigo""")
def normalized_codes(spark, d):
    people = t.persons(spark, d)
    raw = F.array(F.concat(F.lit(" "), "prioridad"), F.concat("segmento", F.lit("\t")),
                  F.concat(F.lit("-00"), F.col("edad").cast("string")))
    return (people.select(F.explode(raw).alias("c"))
            .select(normalize_code(F.col("c")).alias("codigo"))
            .groupBy("codigo").agg(F.count(F.lit(1)).alias("n")))


@query("ordered_categories", with_views("personas") + """
SELECT valor AS texto, count(*) AS n,
       CASE WHEN regexp_full_match(valor, '-?[0-9]+') THEN 0::BIGINT ELSE 1 END AS es_texto,
       CAST(TRY_CAST(valor AS BIGINT) AS DOUBLE) AS numero
FROM (SELECT anios_texto AS valor FROM personas
      UNION ALL SELECT segmento FROM personas) GROUP BY valor""")
def ordered_categories(spark, d):
    values = t.persons(spark, d).select(
        F.explode(F.array("anios_texto", "segmento")).alias("valor"))
    counts = values.groupBy("valor").agg(F.count(F.lit(1)).alias("n"))
    keys = category_sort_keys(F.col("valor"))
    return (counts.orderBy(*category_order(F.col("valor")))
            .select("n", keys["es_texto"].cast("bigint").alias("es_texto"),
                    keys["numero"].cast("double").alias("numero"),
                    keys["texto"].alias("texto")))


@query("municipalities_of_department", with_views("areas") + """
SELECT geo_nombre, geo_code FROM areas WHERE geo_code LIKE '00%'""")
def municipalities_of_department(spark, d):
    from comarca.sources.geometry import area_names
    from workload.layers import area_features_of
    return territory.municipalities_of(area_names(area_features_of(spark, d)), "0")
