"""Census-style views of the star-schema tables, as DataFrames and as SQL.

Every view reads a whole table (or a join of whole tables), so its size follows them.
``SQL[name]`` is the same view for an independent SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# One row per order: region, nation and one municipality per nation.
def persons(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = read(spark, d, "orders"), read(spark, d, "customer")
    joined = (orders.join(customer, orders.o_custkey == customer.c_custkey)
              .join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")))
    code = F.substring("o_orderpriority", 1, 1)
    status = (F.when(F.col("o_orderstatus") == "P", 1)
              .when(F.col("o_orderstatus") == "F", 2).otherwise(3))
    return joined.select(
        F.col("n_regionkey").alias("idep"), F.col("n_nationkey").alias("iprov"),
        F.lit(1).alias("imun"), F.col("o_orderkey").alias("persona"),
        F.lpad(code, 3, "0").alias("prioridad"), code.cast("int").alias("prioridad_num"),
        F.col("c_mktsegment").alias("segmento"), status.alias("v01_tipoviv"),
        F.lpad(status.cast("string"), 2, "0").alias("estado_txt"),
        (F.col("o_orderkey") % 100).cast("int").alias("edad"),
        F.col("o_totalprice").alias("ingreso"),
        F.when(F.col("o_orderstatus") == "F", code.cast("int")).alias("agro"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("s/d"))
        .otherwise((F.col("o_orderkey") % 50).cast("string")).alias("anios_texto"),
        F.when(F.col("o_orderkey") % 11 < 8, (F.col("o_orderkey") % 9).cast("int"))
        .alias("hijos"))


SQL["personas"] = """personas AS (
  SELECT n_regionkey AS idep, n_nationkey AS iprov, 1 AS imun, o_orderkey AS persona,
         lpad(substr(o_orderpriority, 1, 1), 3, '0') AS prioridad,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prioridad_num,
         c_mktsegment AS segmento,
         CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS v01_tipoviv,
         CAST(o_orderkey % 100 AS INTEGER) AS edad, o_totalprice AS ingreso,
         CASE WHEN o_orderstatus = 'F'
              THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS agro,
         CASE WHEN o_orderkey % 7 = 0 THEN 's/d'
              ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS anios_texto,
         CASE WHEN o_orderkey % 11 < 8 THEN CAST(o_orderkey % 9 AS INTEGER) END AS hijos
  FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey)"""


# One row per census unit (supplier), counts of its lines as sheet indicators.
def sheets(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    counts = line.groupBy("l_suppkey").agg(
        F.count_if((flag == "R") & (status == "O")).alias("dev_h"),
        F.count_if((flag == "R") & (status == "F")).alias("dev_m"),
        F.count_if((flag == "A") & (status == "O")).alias("ace_h"),
        F.count_if((flag == "A") & (status == "F")).alias("ace_m"),
        F.count_if(status == "O").alias("pob_total_h"),
        F.count_if(status == "F").alias("pob_total_m"),
        F.count_if((flag == "N") & (status == "O")).alias("solo_h"),
        F.count(F.lit(1)).alias("personas"))
    unit = (counts.join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")))
    return unit.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("-A")).alias("codigo"),
        F.col("s_name").alias("nombre"), (F.col("s_suppkey") % 2 + 1).cast("int").alias("area"),
        F.col("n_regionkey").alias("idep"), F.col("n_nationkey").alias("iprov"),
        F.lit(1).alias("imun"), (F.col("s_suppkey") % 5 != 0).alias("ficha"),
        "dev_h", "dev_m", "ace_h", "ace_m", "pob_total_h", "pob_total_m", "solo_h",
        "personas")


SQL["fichas"] = """fichas AS (
  SELECT 'S' || CAST(s_suppkey AS VARCHAR) || '-A' AS codigo, s_name AS nombre,
         CAST(s_suppkey % 2 + 1 AS INTEGER) AS area, n_regionkey AS idep,
         n_nationkey AS iprov, 1 AS imun, s_suppkey % 5 <> 0 AS ficha, t.*
  FROM (SELECT l_suppkey,
          count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS dev_h,
          count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS dev_m,
          count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O') AS ace_h,
          count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS ace_m,
          count(*) FILTER (WHERE l_linestatus = 'O') AS pob_total_h,
          count(*) FILTER (WHERE l_linestatus = 'F') AS pob_total_m,
          count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O') AS solo_h,
          count(*) AS personas
        FROM lineitem GROUP BY l_suppkey) t
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


# One municipality per customer: code, name, surface, point geometry.
def area_rows(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, d, "customer").select(
        F.expr("CAST(c_custkey div 10000 AS STRING)").alias("idep"),
        F.expr("CAST(c_custkey div 100 % 100 AS STRING)").alias("iprov"),
        (key % 100).cast("string").alias("imun"), F.col("c_name").alias("nombre_mun"),
        F.when(key % 13 != 0, (key % 90 + 10).cast("double")).alias("superficie_km2"),
        F.concat(F.lit('{"type":"Point","coordinates":['), (key % 180).cast("string"),
                 F.lit(","), (key % 90).cast("string"), F.lit("]}")).alias("geometria"))


SQL["areas"] = """areas AS (
  SELECT CASE WHEN c_custkey >= 1000000
              THEN concat_ws('-', CAST(c_custkey // 10000 AS VARCHAR), lpad(CAST(c_custkey // 100 % 100 AS VARCHAR), 2, '0'),
                             lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0'))
              ELSE lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS geo_code,
         c_name AS geo_nombre,
         CASE WHEN c_custkey % 13 <> 0
              THEN CAST(c_custkey % 90 + 10 AS DOUBLE) END AS superficie_km2,
         '{"type":"Point","coordinates":[' || CAST(c_custkey % 180 AS VARCHAR) || ','
         || CAST(c_custkey % 90 AS VARCHAR) || ']}' AS geometria
  FROM customer)"""


# Orders counted in the municipality of their customer.
def residents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(
        F.expr("CAST(o_custkey div 10000 AS INT)").alias("idep"),
        F.expr("CAST(o_custkey div 100 % 100 AS INT)").alias("iprov"),
        F.expr("CAST(o_custkey % 100 AS INT)").alias("imun"),
        F.col("o_totalprice").alias("ingreso"), F.col("o_orderstatus").alias("estado"),
        (F.col("o_orderkey") % 100).cast("int").alias("edad"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("sexo"))


SQL["residentes"] = """residentes AS (
  SELECT CAST(o_custkey // 10000 AS INTEGER) AS idep,
         CAST(o_custkey // 100 % 100 AS INTEGER) AS iprov,
         CAST(o_custkey % 100 AS INTEGER) AS imun, o_totalprice AS ingreso,
         o_orderstatus AS estado, CAST(o_orderkey % 100 AS INTEGER) AS edad,
         CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS sexo
  FROM orders)"""


# Unit geometries: one per supplier, some without geometry.
def units(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").join(
        read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    geometry = F.encode(F.concat(F.lit("WKB"), F.col("s_suppkey").cast("string")), "UTF-8")
    return s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("-A")).alias("codigo"),
        F.col("s_name").alias("nombre"),
        F.when(F.col("s_suppkey") % 2 == 0, "urbana").otherwise("rural").alias("area"),
        F.col("n_regionkey").alias("idep"), F.col("n_nationkey").alias("iprov"),
        F.lit(1).alias("imun"),
        F.when(F.col("s_suppkey") % 17 != 0, geometry).alias("geometria"))


SQL["unidades"] = """unidades AS (
  SELECT 'S' || CAST(s_suppkey AS VARCHAR) || '-A' AS codigo, s_name AS nombre,
         CASE WHEN s_suppkey % 2 = 0 THEN 'urbana' ELSE 'rural' END AS area,
         n_regionkey AS idep, n_nationkey AS iprov, 1 AS imun,
         CASE WHEN s_suppkey % 17 <> 0
              THEN 'WKB' || CAST(s_suppkey AS VARCHAR) END AS geometria
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


# Value labels with repetitions: the last order that mentions a code decides its label.
def label_rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(
        F.concat(F.lit("Var_"), F.col("o_orderkey") % 4).alias("VARIABLE"),
        F.expr("CAST(o_orderkey div 4 % 6 AS STRING)").alias("codigo"),
        F.concat(F.expr("substring(o_orderpriority, 3)"), F.lit(" "),
                 F.col("o_orderstatus")).alias("etiqueta"),
        F.when(F.col("o_orderkey") % 4 == 3, "VIVIENDA")
        .when(F.col("o_orderstatus") == "F", "Persona").otherwise("vivienda")
        .alias("entidad"),
        F.col("o_orderkey").alias("fila"))


SQL["etiquetas"] = """etiquetas AS (
  SELECT 'var_' || CAST(o_orderkey % 4 AS VARCHAR) AS variable,
         CAST(o_orderkey // 4 % 6 AS VARCHAR) AS valor,
         substr(o_orderpriority, 3) || ' ' || o_orderstatus AS etiqueta,
         CASE WHEN o_orderkey % 4 = 3 THEN 'VIVIENDA' WHEN o_orderstatus = 'F'
              THEN 'PERSONA' ELSE 'VIVIENDA' END AS entidad,
         o_orderkey AS fila
  FROM orders)"""


# One variable per part, under the column names of an older dictionary.
def variable_rows(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    slug = (F.when(key % 6 == 0, F.concat(F.lit("personas_"), size, F.lit("_mas")))
            .when(key % 6 == 1, F.concat(F.lit("Mujeres_15_"), size))
            .when(key % 6 == 2, "todas_personas").when(key % 6 == 3, "nan")
            .when(key % 6 == 4, F.concat(F.lit("zonas_de_"), size)))
    return read(spark, d, "part").select(
        F.concat(F.lit(" v"), key.cast("string")).alias("nombre_variable"),
        F.when(key % 9 != 0, F.concat(size, F.lit(". "), F.col("p_name"), F.lit(" "),
                                      F.col("p_type"), F.lit(":")))
        .otherwise("").alias("descripcion"),
        F.when(key % 2 == 0, "Categorica").otherwise("NUMERICA").alias("type"),
        slug.alias("universo"),
        F.when(key % 8 != 0, F.lower(F.translate("p_brand", "#", "_"))).alias("tema"),
        F.when(key % 10 < 4, F.col("p_brand")).alias("tema_etiqueta"),
        F.when(key % 3 == 0, "poblacion").otherwise("vivienda").alias("tabla"))


SQL["variables"] = """variables AS (
  SELECT 'v' || CAST(p_partkey AS VARCHAR) AS variable,
         CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS VARCHAR) || '. ' || p_name
              || ' ' || p_type || ':' ELSE '' END AS label,
         CASE WHEN p_partkey % 2 = 0 THEN 'categorica' ELSE 'numerica' END AS tipo,
         CASE p_partkey % 6 WHEN 0 THEN 'personas_' || CAST(p_size AS VARCHAR) || '_mas'
              WHEN 1 THEN 'mujeres_15_' || CAST(p_size AS VARCHAR)
              WHEN 2 THEN 'todas_personas' WHEN 3 THEN NULL
              WHEN 4 THEN 'zonas_de_' || CAST(p_size AS VARCHAR) END AS universo,
         CASE WHEN p_partkey % 8 <> 0 THEN lower(replace(p_brand, '#', '_')) END AS tema,
         CASE WHEN p_partkey % 10 < 4 THEN p_brand END AS tema_etiqueta,
         CASE WHEN p_partkey % 3 = 0 THEN 'POBLACION' ELSE 'VIVIENDA' END AS entidad
  FROM part)"""


# Questionnaires: a conversation is one, its turns are the questions, whole texts kept.
# Question numbers are far apart, so skips pass over long stretches of numbers.
STEP = 100_003


def doc_rows(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    num = lambda more: ((turn + more) * STEP + 1).cast("string")
    skip = F.concat(F.lit(" 1 Sí ( PASE A P"), num(2), F.lit(") 2 "),
                    F.col("role"), F.lit(" (pase a "), num(1),
                    F.lit(") 3 ¿Otra? (Pase  a P."), num(3), F.lit(")"),
                    F.when(turn % 6 == 4, " 4 Nunca (Pase a P.9999999999)").otherwise(""))
    return read(spark, d, "conversations").select(
        F.lit(2024).alias("anio"), F.concat(F.lit("c"), F.col("conv_id").cast("string"))
        .alias("tabla"),
        F.concat(F.lit("v"), F.lpad(turn.cast("string"), 4, "0")).alias("variable"),
        F.when(turn % 3 != 0, F.col("text")).alias("definicion"),
        F.concat(num(0), F.lit(". "), F.col("text"),
                 F.when(turn % 2 == 0, skip).otherwise("")).alias("pregunta_literal"),
        F.when(turn % 2 == 1, F.col("role")).alias("universo_literal"),
        F.when(turn % 4 == 0, F.col("text")).alias("regla_derivacion"))


WHITE = (r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _squeezed(text: str) -> str:
    return f"coalesce(trim(regexp_replace({text}, '{WHITE}+', ' ', 'g')), '')"


SQL["docs"] = f"""docs AS (
  SELECT 2024 AS anio, 'c' || CAST(conv_id AS VARCHAR) AS tabla,
         'v' || lpad(CAST(turn AS VARCHAR), 4, '0') AS variable,
         {_squeezed("CASE WHEN turn % 3 <> 0 THEN text END")} AS definicion,
         {_squeezed(f'''CAST(turn * {STEP} + 1 AS VARCHAR) || '. ' || text || CASE WHEN turn % 2 = 0
            THEN ' 1 Sí ( PASE A P' || CAST((turn + 2) * {STEP} + 1 AS VARCHAR) || ') 2 ' || role
                 || ' (pase a ' || CAST((turn + 1) * {STEP} + 1 AS VARCHAR) || ') 3 ¿Otra? (Pase  a P.'
                 || CAST((turn + 3) * {STEP} + 1 AS VARCHAR) || ')'
                 || CASE WHEN turn % 6 = 4 THEN ' 4 Nunca (Pase a P.9999999999)' ELSE '' END ELSE '' END''')} AS pregunta_literal,
         {_squeezed("CASE WHEN turn % 2 = 1 THEN role END")} AS universo_literal,
         {_squeezed("CASE WHEN turn % 4 = 0 THEN text END")} AS regla_derivacion
  FROM conversations)"""


# Sheet-column dictionary: four columns per part, sexes in pairs.
def catalogue_source(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    kinds = F.array(*[F.struct(F.lit(s).alias("suf"), F.lit(t).alias("sexo"))
                      for s, t in (("_h", ", hombres"), ("_m", ", mujeres"), ("_t", ""))])
    rows = part.select("*", F.explode(kinds).alias("k")).filter(
        "k.suf <> '_m' OR p_partkey % 5 <> 0")
    block = F.concat(F.lit("b"), (F.col("p_size") % 7).cast("string"))
    return rows.select(
        F.when(F.col("p_partkey") % 3 == 0, "unidad").otherwise("ficha").alias("tabla"),
        F.concat(F.lit("i"), key, F.col("k.suf")).alias("variable"),
        F.concat(F.col("p_name"), F.col("k.sexo")).alias("etiqueta"), block.alias("bloque"),
        F.when(F.col("p_size") % 7 != 3, F.concat(F.lit("Bloque "), block))
        .alias("bloque_etiqueta"),
        F.when(F.col("p_partkey") % 2 == 0, "numerica").alias("tipo"),
        F.when(F.col("k.suf") == "_h", "tot_h").when(F.col("k.suf") == "_m", "tot_m")
        .alias("denominador"), F.lower("p_type").alias("tema"),
        F.col("p_type").alias("tema_etiqueta"),
        F.when(F.col("p_size") % 7 != 5, F.col("p_size") % 7).alias("bloque_orden"))


SQL["cat_origen"] = """cat_origen AS (
  SELECT CASE WHEN p_partkey % 3 = 0 THEN 'unidades' ELSE 'fichas' END AS tabla,
         'i' || CAST(p_partkey AS VARCHAR) AS base, suf,
         'i' || CAST(p_partkey AS VARCHAR) || suf AS variable, p_name || sexo AS etiqueta,
         'b' || CAST(p_size % 7 AS VARCHAR) AS bloque,
         CASE WHEN p_size % 7 <> 3 THEN 'Bloque b' || CAST(p_size % 7 AS VARCHAR)
              ELSE '' END AS bloque_etiqueta,
         'numerica' AS tipo,
         CASE suf WHEN '_h' THEN 'tot_h' WHEN '_m' THEN 'tot_m' ELSE '' END AS denominador,
         lower(p_type) AS tema, p_type AS tema_etiqueta, p_partkey
  FROM part CROSS JOIN (VALUES ('_h', ', hombres'), ('_m', ', mujeres'), ('_t', ''))
       AS k(suf, sexo)
  WHERE suf <> '_m' OR p_partkey % 5 <> 0)"""

DEP = "CASE WHEN idep > 99 THEN CAST(idep AS VARCHAR) ELSE lpad(CAST(idep AS VARCHAR), 2, '0') END"
_BORDER = "CASE WHEN idep > 99 THEN '-' ELSE '' END"      # provinces and municipalities have two digits
MUN = (f"{DEP} || {_BORDER} || lpad(CAST(iprov AS VARCHAR), 2, '0') || {_BORDER} || lpad(CAST(imun AS VARCHAR), 2, '0')")


def with_views(*names: str) -> str:
    """The WITH clause of the views a query reads."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
