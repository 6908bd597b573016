"""Classes, histograms, rankings, legends, quality notes and number formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from comarca.functions.text import code_with_label, format_number, variable_label
from comarca.operators import classify, codebook, measures, quality
from comarca.sources.tables import GeoColumns
from comarca.spec import IndicatorSpec
from workload import tables as t
from workload.registry import query
from workload.tables import MUN, with_views

# Values to class: average quantity per supplier (many territories) …
_UNITS = """units AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS geo_code, round(avg(l_quantity), 4) AS valor,
         count(l_quantity) AS casos FROM lineitem GROUP BY 1)"""
# … and share of urgent orders per nation (few).
_NATIONS = f"""nations AS (
  SELECT {MUN} AS geo_code,
         round(100.0 * count(*) FILTER (WHERE prioridad_num = 1) / count(*), 2) AS valor,
         count(*) AS casos FROM personas GROUP BY 1)"""


def _units(spark, d):
    return measures.indicator(t.read(spark, d, "lineitem"),
                              IndicatorSpec("unidad", "mean", "l_quantity"),
                              GeoColumns(unit="l_suppkey"))


def _nations(spark, d):
    return measures.indicator(t.persons(spark, d),
                              IndicatorSpec("municipio", "pct_total", "prioridad", 1))


# Limits by method; class i of the bounds lies between limits i and i+1.
_EDGES = {
    "equal": """SELECT lo + (hi - lo) / k * i AS e
        FROM (SELECT min(valor) AS lo, max(valor) AS hi,
                     least(count(DISTINCT valor), 5) AS k FROM {r}), range(0, 6) t(i)
        WHERE i <= k""",
    "quantile": """SELECT unnest(quantile_cont(valor, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS e
        FROM {r}""",
    "stddev": """SELECT least(hi, greatest(lo, m + (i - 2.5) * s)) AS e
        FROM (SELECT min(valor) AS lo, max(valor) AS hi, avg(valor) AS m,
                     stddev_pop(valor) AS s FROM {r}), (VALUES (-99), (1), (2), (3), (4), (99))
             AS t(i)""",
}


def _bounds_sql(method, views, rows, r):
    edges = _EDGES[method].format(r=r)
    head = with_views(*views).rstrip() + ",\n" if views else "WITH "
    return head + f"""{rows},
edges AS (SELECT DISTINCT e FROM ({edges})),
bounds AS (SELECT row_number() OVER (ORDER BY e) AS clase, e AS desde,
                  lead(e) OVER (ORDER BY e) AS hasta FROM edges
           QUALIFY hasta IS NOT NULL)
"""


def _with_units(method):
    return _bounds_sql(method, [], _UNITS, "units")


def _rounded_bounds(df):
    return df.select(F.col("clase").cast("bigint").alias("clase"),
                     F.round("desde", 6).alias("desde"), F.round("hasta", 6).alias("hasta"))


def _bounds_query(method):
    sql = _with_units(method) + """
SELECT clase, round(desde, 6) AS desde, round(hasta, 6) AS hasta FROM bounds"""

    @query(f"class_bounds_{method}", sql)
    def run(spark, d):
        return _rounded_bounds(classify.class_bounds(_units(spark, d), method))
    return run


for _method in _EDGES:
    _bounds_query(_method)


# Least squared deviation by trying every way to cut 25 territories into five classes.
_JENKS = with_views("personas").rstrip() + f""",
{_NATIONS},
v AS (SELECT valor, count(*) AS w, row_number() OVER (ORDER BY valor) AS i
      FROM nations GROUP BY valor),
p AS (SELECT i, valor, sum(w) OVER o AS w, sum(w * (valor - 20)) OVER o AS s,
             sum(w * (valor - 20) * (valor - 20)) OVER o AS q
      FROM v WINDOW o AS (ORDER BY i)
      UNION ALL SELECT 0, NULL, 0, 0, 0),
c AS (SELECT a.i AS i, b.i AS j, b.q - a.q - (b.s - a.s) * (b.s - a.s) / (b.w - a.w) AS cost
      FROM p a JOIN p b ON a.i < b.i),
best AS (SELECT c1.j AS a, c2.j AS b, c3.j AS c, c4.j AS d
  FROM c c1 JOIN c c2 ON c2.i = c1.j JOIN c c3 ON c3.i = c2.j JOIN c c4 ON c4.i = c3.j
  JOIN c c5 ON c5.i = c4.j
  WHERE c1.i = 0 AND c5.j = (SELECT max(i) FROM p)
  ORDER BY c1.cost + c2.cost + c3.cost + c4.cost + c5.cost LIMIT 1),
cuts AS (SELECT valor AS e FROM p, best WHERE i IN (1, a, b, c, d)
         UNION SELECT max(valor) FROM v),
bounds AS (SELECT row_number() OVER (ORDER BY e) AS clase, e AS desde,
                  lead(e) OVER (ORDER BY e) AS hasta FROM cuts QUALIFY hasta IS NOT NULL)
"""


@query("class_bounds_jenks", _JENKS + """
SELECT clase, round(desde, 6) AS desde, round(hasta, 6) AS hasta FROM bounds""")
def class_bounds_jenks(spark, d):
    return _rounded_bounds(classify.class_bounds(_nations(spark, d), "jenks"))


# The same by dynamic programming: the cheapest way to reach a value with c classes.
_REACH = "".join(f"""
d{c} AS (SELECT c.j AS j, min(d{c - 1}.cost + c.cost) AS cost,
                arg_min(c.i, d{c - 1}.cost + c.cost) AS back
         FROM d{c - 1} JOIN c ON c.i = d{c - 1}.j GROUP BY c.j),""" for c in range(2, 6))
_JENKS_UNITS = "WITH " + _UNITS + f""",
v AS (SELECT valor, count(*) AS w, row_number() OVER (ORDER BY valor) AS i
      FROM units GROUP BY valor),
p AS (SELECT i, valor, sum(w) OVER o AS w, sum(w * (valor - 25)) OVER o AS s,
             sum(w * (valor - 25) * (valor - 25)) OVER o AS q
      FROM v WINDOW o AS (ORDER BY i)
      UNION ALL SELECT 0, NULL, 0, 0, 0),
c AS (SELECT a.i AS i, b.i AS j, b.q - a.q - (b.s - a.s) * (b.s - a.s) / (b.w - a.w) AS cost
      FROM p a JOIN p b ON a.i < b.i),
d1 AS (SELECT j, cost, i AS back FROM c WHERE i = 0),{_REACH}
t5 AS (SELECT back AS x4 FROM d5 WHERE j = (SELECT max(i) FROM p)),
t4 AS (SELECT back AS x3, x4 FROM t5 JOIN d4 ON j = x4),
t3 AS (SELECT back AS x2, x3, x4 FROM t4 JOIN d3 ON j = x3),
t2 AS (SELECT back AS x1, x2, x3, x4 FROM t3 JOIN d2 ON j = x2),
cuts AS (SELECT valor AS e FROM p, t2 WHERE i IN (1, x1, x2, x3, x4)
         UNION SELECT max(valor) FROM v),
bounds AS (SELECT row_number() OVER (ORDER BY e) AS clase, e AS desde,
                  lead(e) OVER (ORDER BY e) AS hasta FROM cuts QUALIFY hasta IS NOT NULL)
"""


@query("class_bounds_jenks_units", _JENKS_UNITS + """
SELECT clase, round(desde, 6) AS desde, round(hasta, 6) AS hasta FROM bounds""")
def class_bounds_jenks_units(spark, d):
    return _rounded_bounds(classify.class_bounds(_units(spark, d), "jenks"))


# Thousands of different values (the total of every order), by the same programme.
_ORDERS_REACH = "".join(f"""
d{c} AS (SELECT b.i AS j, min(d.cost + b.q - a.q - (b.s - a.s) * (b.s - a.s) / (b.w - a.w)) AS cost,
                arg_min(a.i, d.cost + b.q - a.q - (b.s - a.s) * (b.s - a.s) / (b.w - a.w)) AS back
         FROM d{c - 1} d JOIN p a ON a.i = d.j JOIN p b ON b.i > a.i {"WHERE b.i = (SELECT max(i) FROM p)" if c == 5 else ""} GROUP BY b.i),"""
                        for c in range(2, 6))


@query("class_bounds_jenks_orders", f"""
WITH v AS (SELECT o_totalprice AS valor, count(*)::DOUBLE AS w, row_number() OVER (ORDER BY o_totalprice) AS i FROM orders GROUP BY 1),
m AS (SELECT sum(w * valor) / sum(w) AS m FROM v),
p AS MATERIALIZED (SELECT i, valor, sum(w) OVER o AS w, sum(w * (valor - m)) OVER o AS s, sum(w * (valor - m) * (valor - m)) OVER o AS q
      FROM v, m WINDOW o AS (ORDER BY i) UNION ALL SELECT 0, NULL, 0, 0, 0),
d1 AS (SELECT i AS j, q - s * s / w AS cost, 0 AS back FROM p WHERE i > 0),{_ORDERS_REACH}
t2 AS (SELECT d2.back AS x1, d2.j AS x2, d3.j AS x3, d4.j AS x4 FROM d5 JOIN d4 ON d4.j = d5.back JOIN d3 ON d3.j = d4.back JOIN d2 ON d2.j = d3.back),
cuts AS (SELECT valor AS e FROM p, t2 WHERE i IN (1, x1, x2, x3, x4) UNION SELECT max(valor) FROM v),
bounds AS (SELECT row_number() OVER (ORDER BY e) AS clase, e AS desde, lead(e) OVER (ORDER BY e) AS hasta FROM cuts QUALIFY hasta IS NOT NULL)
SELECT clase, round(desde, 6) AS desde, round(hasta, 6) AS hasta FROM bounds""")
def class_bounds_jenks_orders(spark, d):
    return _rounded_bounds(classify.class_bounds(t.read(spark, d, "orders").select(F.col("o_totalprice").alias("valor")), "jenks"))


@query("legend_of_many_values", with_views("personas") + """
SELECT CAST(row_number() OVER (ORDER BY valor) - 1 AS BIGINT) AS codigo, valor, valor AS texto FROM (
  SELECT DISTINCT CAST(edad AS VARCHAR) AS valor FROM personas WHERE edad IS NOT NULL)""")
def legend_of_many_values(spark, d):
    return classify.category_legend(t.persons(spark, d).select(F.col("edad").alias("valor")))


@query("histogram_of_classes", _with_units("quantile") + """
SELECT clase, count(valor) AS n FROM bounds LEFT JOIN units
ON valor >= desde AND (valor < hasta OR (valor = hasta
   AND hasta = (SELECT max(hasta) FROM bounds))) GROUP BY clase""")
def histogram_of_classes(spark, d):
    bars = classify.histogram(_units(spark, d), "quantile")
    return bars.select(F.col("clase").cast("bigint").alias("clase"), "n")


@query("class_of_each_territory", _JENKS + """
SELECT geo_code, valor, min(clase) AS clase FROM nations JOIN bounds
ON valor >= desde AND valor <= hasta GROUP BY geo_code, valor""")
def class_of_each_territory(spark, d):
    found = classify.with_class(_nations(spark, d), "jenks")
    return found.select("geo_code", "valor", F.col("clase").cast("bigint").alias("clase"))


_SHARED_ROWS = """layers AS (
  SELECT l_returnflag || l_linestatus AS capa, CAST(l_suppkey AS VARCHAR) AS geo_code,
         round(avg(l_quantity), 4) AS valor FROM lineitem
  GROUP BY 1, 2),
sizes AS (SELECT capa, count(*) AS n FROM layers GROUP BY capa),
main AS (SELECT valor FROM layers WHERE capa = (
  SELECT capa FROM sizes ORDER BY n DESC, capa LIMIT 1))"""


@query("shared_classes", _bounds_sql("equal", [], _SHARED_ROWS, "main") + """
SELECT capa, geo_code, CAST(min(clase) AS DOUBLE) AS clase FROM layers LEFT JOIN bounds
ON valor >= desde AND valor <= hasta GROUP BY capa, geo_code""")
def shared_classes(spark, d):
    rows = t.read(spark, d, "lineitem")
    layers = rows.groupBy(F.concat("l_returnflag", "l_linestatus").alias("capa"),
                          F.col("l_suppkey").cast("string").alias("geo_code")).agg(
        F.round(F.avg("l_quantity"), 4).alias("valor"))
    found = classify.shared_classes(layers, "capa", "equal")
    return found.select("capa", "geo_code", F.col("clase").cast("double").alias("clase"))


@query("category_legend", with_views("personas") + """
SELECT row_number() OVER (ORDER BY valor) - 1 AS codigo, valor, valor AS texto
FROM (SELECT DISTINCT prioridad AS valor FROM personas)""")
def category_legend(spark, d):
    result = t.persons(spark, d).select(F.col("prioridad").alias("valor"))
    return classify.category_legend(result).withColumn("codigo",
                                                       F.col("codigo").cast("bigint"))


@query("ranking", with_views("personas").rstrip() + f""",
r AS (SELECT {MUN} AS geo_code, round(avg(edad), 4) - 49 AS valor FROM personas GROUP BY 1),
s AS (SELECT least(min(valor), 0) AS base, max(valor) AS hi FROM r)
SELECT geo_code, geo_code AS nombre, round(valor, 4) AS valor,
       CAST(greatest(1, least(100, floor((valor - base) / (hi - base) * 100))) AS BIGINT)
         AS barra FROM r, s ORDER BY r.valor DESC LIMIT 15""")
def ranking(spark, d):
    result = measures.indicator(t.persons(spark, d), IndicatorSpec("municipio", "mean", "edad"))
    top = classify.ranking(result.withColumn("valor", F.col("valor") - 49))
    return top.select("geo_code", "nombre", F.round("valor", 4).alias("valor"),
                      F.col("barra").cast("bigint").alias("barra"))


@query("summary_view", with_views("personas").rstrip() + f""",
{_NATIONS}
SELECT 'ranking' AS vista, row_number() OVER (ORDER BY valor DESC, geo_code) AS orden,
       geo_code AS texto, valor,
       greatest((SELECT count(valor) FROM nations) - 15, 0) AS quedan_fuera
FROM nations QUALIFY orden <= 15""")
def summary_view(spark, d):
    spec = IndicatorSpec("municipio", "pct_total", "prioridad", 1)
    view = classify.summary_view(_nations(spark, d), spec, "quantile")
    return view.withColumn("orden", F.col("orden").cast("bigint"))


@query("summary_view_units", _with_units("equal") + """
SELECT 'histograma' AS vista, clase AS orden, CAST(count(valor) AS DOUBLE) AS valor
FROM bounds LEFT JOIN units ON valor >= desde AND (valor < hasta OR (valor = hasta
   AND hasta = (SELECT max(hasta) FROM bounds))) GROUP BY clase""")
def summary_view_units(spark, d):
    spec = IndicatorSpec("unidad", "mean", "l_quantity")
    view = classify.summary_view(_units(spark, d), spec, "equal")
    return view.select("vista", F.col("orden").cast("bigint").alias("orden"), "valor")


# --- quality -------------------------------------------------------------------------

_FRAGILE = with_views("residentes").rstrip() + f""",
r AS (SELECT {MUN} AS geo_code, round(100.0 * count(*) FILTER (WHERE estado = 'F')
        / nullif(count(CASE WHEN edad < 30 THEN estado END), 0), 2) AS valor,
        count(CASE WHEN edad < 30 THEN estado END) AS casos FROM residentes GROUP BY 1)
"""


def _partly(spark, d):
    people = t.residents(spark, d).withColumn(
        "estado_joven", F.when(F.col("edad") < 30, F.col("estado")))
    spec = IndicatorSpec("municipio", "pct_category", "estado_joven", "F")
    return measures.indicator(people, spec)


@query("fragile_cells", _FRAGILE + """
SELECT geo_code, casos, valor IS NOT NULL AND casos < 5 AS fragil FROM r""")
def fragile_cells(spark, d):
    return quality.with_fragile_flag(_partly(spark, d)).select("geo_code", "casos", "fragil")


@query("fragile_summary", _FRAGILE + """
SELECT count(*) FILTER (WHERE valor IS NOT NULL AND casos < 5) AS n_fragiles,
       count(valor) AS n_con_valor FROM r""")
def fragile_summary(spark, d):
    return quality.fragile_summary(_partly(spark, d), "pct_category")


@query("denominator_note", with_views("personas") + """
SELECT 'agro' AS variable, count(*) AS n_total, count(agro) AS n_valid,
       'casos_con_dato' AS denominador, count(agro) AS n_denominador, count(*) AS n_otro,
       round(100.0 * count(agro) / count(*), 1) AS pct_con_dato, TRUE AS cobertura_baja
FROM personas UNION ALL
SELECT 'edad', count(*), count(edad), 'casos_con_dato', count(edad), count(*),
       round(100.0 * count(edad) / count(*), 1), FALSE FROM personas""")
def denominator_note(spark, d):
    sizes = measures.coverage(t.persons(spark, d), ["agro", "edad"])
    return quality.denominator_note(sizes, "pct_category")


@query("sheet_coverage", with_views("fichas") + """
SELECT lpad(CAST(idep AS VARCHAR), 2, '0') AS geo_code,
       CAST(sum(personas) AS BIGINT) AS poblacion,
       CAST(coalesce(sum(personas) FILTER (WHERE ficha), 0) AS BIGINT) AS con_ficha,
       round(100.0 * coalesce(sum(personas) FILTER (WHERE ficha), 0) / sum(personas), 2)
         AS cobertura_pct FROM fichas GROUP BY 1""")
def sheet_coverage(spark, d):
    return quality.sheet_coverage(t.sheets(spark, d), "departamento")


# --- presentation ----------------------------------------------------------------------

_NUM = """CASE WHEN abs(v - round(v)) < 1e-9
  THEN translate(format('{:,}', CAST(round(v) AS BIGINT)), ',', '.')
  ELSE translate(regexp_replace(format('{:,.2f}', v), '\\.?0+$', ''), ',.', '.,') END"""


@query("formatted_numbers", f"""
SELECT n, v, {_NUM} AS texto,
       replace(format('{{:.1f}}', v), '.', ',') || '%' AS porcentaje
FROM (SELECT c_custkey AS n, c_acctbal * (c_custkey % 4) * 250 AS v FROM customer)""")
def formatted_numbers(spark, d):
    value = (F.col("c_acctbal") * (F.col("c_custkey") % 4) * 250).alias("v")
    rows = t.read(spark, d, "customer").select(F.col("c_custkey").alias("n"), value)
    return rows.select("n", "v", format_number(F.col("v")).alias("texto"),
                       format_number(F.col("v"), percent=True).alias("porcentaje"))


@query("variable_labels", with_views("variables").rstrip() + """,
s AS (SELECT variable, label, trim(rtrim(trim(regexp_replace(label, '^[0-9]+\\. ', '')), ':.'))
        AS b FROM variables)
SELECT variable, CASE WHEN label = '' THEN variable
  WHEN length(b) > 20 THEN rtrim(substr(b, 1, 20), ' ,;') || '… (' || variable || ')'
  ELSE b || ' (' || variable || ')' END AS texto FROM s""")
def variable_labels(spark, d):
    rows = codebook.variable_dictionary(t.variable_rows(spark, d))
    return rows.select("variable", variable_label(F.col("variable"), F.col("label"), 20)
                       .alias("texto"))


@query("reference_labels", with_views("personas") + " UNION ALL ".join(
    f"SELECT '{m}' AS medida, replace(format('{{:.1f}}', v), '.', ',') || '%' AS texto "
    f"FROM (SELECT round(100.0 * count(*) FILTER (WHERE agro = 2) / {den}, 2) AS v "
    "FROM personas)" for m, den in (("pct_category", "count(agro)"),
                                    ("pct_total", "count(*)"))))
def reference_labels(spark, d):
    parts = []
    for m in ("pct_category", "pct_total"):
        spec = IndicatorSpec(measure=m, variable="agro", category=2)
        value = measures.reference_value(t.persons(spark, d), spec)
        parts.append(value.select(F.lit(m).alias("medida"), format_number(
            F.col("valor"), percent=spec.is_percentage).alias("texto")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("coded_categories", with_views("personas") + """
SELECT DISTINCT CAST(prioridad_num AS VARCHAR) || ' — ' || substr(o_orderpriority, 3)
  AS texto FROM personas JOIN orders ON o_orderkey = persona""")
def coded_categories(spark, d):
    rows = t.read(spark, d, "orders")
    return rows.select(code_with_label(F.substring("o_orderpriority", 1, 1),
                                       F.expr("substring(o_orderpriority, 3)"))
                       .alias("texto")).distinct()
