"""The measures, references, free expressions, sheets, coverage and batches."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from comarca.operators import classify, measures, quantiles, sheets
from comarca.operators.layers import with_names
from comarca.operators.territory import geo_code, with_geo_code
from comarca.sources.tables import GeoColumns
from comarca.spec import IndicatorSpec
from workload import tables as t
from workload.registry import query
from workload.tables import DEP, MUN, with_views

PCT = dict(variable="prioridad", category="2")


def _run(spark, d, level="municipio", **spec):
    return measures.indicator(t.persons(spark, d), IndicatorSpec(level, **spec))


def _rounded(df):
    """Sums of decimals differ in the last bits with the order of addition."""
    return df.withColumn("valor", F.round("valor", 2))


def _grouped(code, valor, casos, where="TRUE"):
    return with_views("personas") + f"""
SELECT {code} AS geo_code, {valor} AS valor, {casos} AS casos
FROM personas WHERE {where} GROUP BY 1"""


@query("count_by_municipality", _grouped(MUN, "CAST(count(*) AS DOUBLE)", "count(*)"))
def count_by_municipality(spark, d):
    return _run(spark, d)


@query("count_of_category", _grouped(MUN, "CAST(count(*) AS DOUBLE)", "count(*)",
                                     "prioridad_num = 2"))
def count_of_category(spark, d):
    return _run(spark, d, **PCT)


@query("mean_by_municipality", _grouped(MUN, "round(avg(edad), 4)", "count(edad)"))
def mean_by_municipality(spark, d):
    return _run(spark, d, measure="mean", variable="edad")


@query("mean_of_partly_numeric_text", _grouped(
    MUN, "round(avg(TRY_CAST(anios_texto AS DOUBLE)), 4)", "count(anios_texto)"))
def mean_of_partly_numeric_text(spark, d):
    return _run(spark, d, measure="mean", variable="anios_texto")


@query("sum_by_municipality", _grouped(MUN, "round(sum(ingreso), 2)", "count(ingreso)"))
def sum_by_municipality(spark, d):
    return _rounded(_run(spark, d, measure="sum", variable="ingreso"))


@query("median_by_municipality", _grouped(MUN, "round(median(ingreso), 4)", "count(ingreso)"))
def median_by_municipality(spark, d):
    return _run(spark, d, measure="median", variable="ingreso")


@query("median_of_partly_asked", _grouped(
    DEP, "round(median(CAST(hijos AS DOUBLE)), 4)", "count(hijos)", "hijos IS NOT NULL"))
def median_of_partly_asked(spark, d):
    return _run(spark, d, "departamento", measure="median", variable="hijos")


@query("std_by_municipality", _grouped(MUN, "round(stddev(ingreso), 4)", "count(ingreso)"))
def std_by_municipality(spark, d):
    return _run(spark, d, measure="std", variable="ingreso")


def _mode_sql(code, variable):
    return with_views("personas") + f"""
SELECT geo_code, valor, casos FROM (
  SELECT geo_code, valor, sum(n) OVER (PARTITION BY geo_code)::BIGINT AS casos,
         row_number() OVER (PARTITION BY geo_code ORDER BY n DESC, valor) AS lugar
  FROM (SELECT {code} AS geo_code, {variable} AS valor, count(*) AS n
        FROM personas WHERE {variable} IS NOT NULL GROUP BY 1, 2)) WHERE lugar = 1"""


@query("mode_by_municipality", _mode_sql(MUN, "prioridad"))
def mode_by_municipality(spark, d):
    return _run(spark, d, measure="mode", variable="prioridad")


@query("mode_of_many_values", _mode_sql(MUN, "edad"))
def mode_of_many_values(spark, d):
    return _run(spark, d, measure="mode", variable="edad")


@query("pct_of_valid", _grouped(
    MUN, "round(100.0 * count(*) FILTER (WHERE agro = 2) / nullif(count(agro), 0), 2)",
    "count(agro)"))
def pct_of_valid(spark, d):
    return _run(spark, d, measure="pct_category", variable="agro", category="2")


@query("pct_of_all", _grouped(
    MUN, "round(100.0 * count(*) FILTER (WHERE agro = 2) / count(*), 2)", "count(*)"))
def pct_of_all(spark, d):
    return _run(spark, d, measure="pct_total", variable="agro", category="2")


@query("indicator_with_names", with_views("personas") + f"""
SELECT geo_code, coalesce(n_name, geo_code) AS geo_nombre, valor, casos FROM (
  SELECT {MUN} AS geo_code, iprov, round(avg(edad), 4) AS valor, count(edad) AS casos
  FROM personas WHERE v01_tipoviv <> 3 GROUP BY 1, 2) LEFT JOIN nation
ON n_nationkey = iprov""")
def indicator_with_names(spark, d):
    people = t.persons(spark, d)
    result = measures.indicator(people, IndicatorSpec("municipio", "mean", "edad"),
                                universe=F.col("v01_tipoviv") != 3)
    key = F.col("n_nationkey").cast("string")
    names = t.read(spark, d, "nation").select(
        F.concat(F.lpad(F.col("n_regionkey").cast("string"), 2, "0"),
                 F.lpad(key, 2, "0"), F.lit("01")).alias("geo_code"),
        F.col("n_name").alias("geo_nombre"))
    return with_names(result, names)


_MUN_RESIDENTS = MUN.replace("idep", "r.idep").replace("iprov", "r.iprov").replace("imun", "r.imun")


# Names come from another register (suppliers), which has not all of the municipalities.
@query("names_from_another_register", with_views("residentes") + f"""
SELECT geo_code, coalesce(s_name, geo_code) AS geo_nombre, valor, casos FROM (
  SELECT {_MUN_RESIDENTS} AS geo_code, idep * 10000 + iprov * 100 + imun AS llave,
         round(avg(edad), 4) AS valor, count(edad) AS casos
  FROM residentes r GROUP BY 1, 2) LEFT JOIN supplier ON s_suppkey = llave""")
def names_from_another_register(spark, d):
    result = measures.indicator(t.residents(spark, d), IndicatorSpec("municipio", "mean", "edad"))
    places = t.read(spark, d, "supplier").select(
        F.expr("s_suppkey div 10000").alias("idep"), F.expr("s_suppkey div 100 % 100").alias("iprov"),
        F.expr("s_suppkey % 100").alias("imun"), "s_name")
    names = with_geo_code(places, "municipio").select("geo_code", F.col("s_name").alias("geo_nombre"))
    return with_names(result, names)


REFERENCES = {
    "conteo": (IndicatorSpec(), "CAST(count(*) AS DOUBLE)", "count(*)"),
    "conteo_cat": (IndicatorSpec(**PCT), "CAST(count(*) FILTER (WHERE prioridad_num = 2)"
                   " AS DOUBLE)", "count(*) FILTER (WHERE prioridad_num = 2)"),
    "media": (IndicatorSpec(measure="mean", variable="edad"), "avg(edad)", "count(edad)"),
    "suma": (IndicatorSpec(measure="sum", variable="ingreso"), "sum(ingreso)",
             "count(ingreso)"),
    "mediana": (IndicatorSpec(measure="median", variable="ingreso"), "median(ingreso)",
                "count(ingreso)"),
    "desviacion": (IndicatorSpec(measure="std", variable="ingreso"), "stddev(ingreso)",
                   "count(ingreso)"),
    "pct_valid": (IndicatorSpec(measure="pct_category", variable="agro", category=2),
                  "100.0 * count(*) FILTER (WHERE agro = 2) / count(agro)", "count(agro)"),
    "pct_todos": (IndicatorSpec(measure="pct_total", variable="agro", category=2),
                  "100.0 * count(*) FILTER (WHERE agro = 2) / count(*)", "count(*)"),
}


@query("reference_values", with_views("personas") + " UNION ALL ".join(
    f"SELECT '{name}' AS medida, round({v}, 2) AS valor, {c} AS casos FROM personas"
    " WHERE idep = 1" for name, (_, v, c) in REFERENCES.items()))
def reference_values(spark, d):
    people = t.persons(spark, d)
    parts = [measures.reference_value(people, replace(s, department="01"))
             .select(F.lit(name).alias("medida"), F.round("valor", 2).alias("valor"), "casos")
             for name, (s, _, _) in REFERENCES.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("reference_mode", with_views("personas") + """
SELECT valor, CAST(total AS BIGINT) AS casos FROM (
  SELECT segmento AS valor, sum(count(*)) OVER () AS total,
         row_number() OVER (ORDER BY count(*) DESC, segmento) AS lugar
  FROM personas GROUP BY segmento) WHERE lugar = 1""")
def reference_mode(spark, d):
    return measures.reference_value(t.persons(spark, d),
                                    IndicatorSpec(measure="mode", variable="segmento"))


def _report_sql(valor, casos, n_valid, where="TRUE"):
    cols = f"{valor} AS valor, {casos} AS casos, count(*) AS n_total, {n_valid} AS n_valid"
    return with_views("personas") + f"""
SELECT FALSE AS es_total, {MUN} AS geo_code, {cols} FROM personas WHERE {where} GROUP BY ALL
UNION ALL SELECT TRUE, NULL, {cols} FROM personas WHERE {where}"""


def _report(spark, d, **spec):
    return measures.indicator_report(t.persons(spark, d), IndicatorSpec("municipio", **spec))


@query("report_pct", _report_sql(
    "round(100.0 * count(*) FILTER (WHERE agro = 2) / nullif(count(agro), 0), 2)",
    "count(agro)", "count(agro)"))
def report_pct(spark, d):
    return _report(spark, d, measure="pct_category", variable="agro", category="2")


@query("report_sum", _report_sql("round(sum(ingreso), 2)", "count(ingreso)", "count(ingreso)"))
def report_sum(spark, d):
    return _rounded(_report(spark, d, measure="sum", variable="ingreso"))


@query("report_std", _report_sql("round(stddev(hijos), 4)", "count(hijos)", "count(hijos)"))
def report_std(spark, d):
    return _report(spark, d, measure="std", variable="hijos")


@query("report_median", _report_sql("round(median(CAST(hijos AS DOUBLE)), 4)",
                                    "count(hijos)", "count(hijos)"))
def report_median(spark, d):
    return _report(spark, d, measure="median", variable="hijos")


# --- free expressions -------------------------------------------------------------

EXPRESSIONS = {
    "expression_mean": "AVG(edad)",
    "expression_pct_valid": "100D * COUNT(CASE WHEN sexo = 1 THEN 1 END)"
                            " / NULLIF(COUNT(sexo), 0)",
    "expression_dependency_ratio": "100D * COUNT(CASE WHEN edad < 15 OR edad >= 65"
                                   " THEN 1 END) / NULLIF(COUNT(CASE WHEN edad"
                                   " BETWEEN 15 AND 64 THEN 1 END), 0)",
    "expression_sex_ratio": "100D * COUNT(CASE WHEN sexo = 1 THEN 1 END)"
                            " / NULLIF(COUNT(CASE WHEN sexo = 2 THEN 1 END), 0)",
}


def _expression(name, text):
    sql = with_views("residentes") + f"""
SELECT {MUN} AS geo_code, round({text.replace('100D', '100.0::DOUBLE')}, 6) AS valor,
       count(edad) AS casos FROM residentes GROUP BY 1"""

    @query(name, sql)
    def run(spark, d):
        spec = IndicatorSpec("municipio", expression=f"round({text}, 6)",
                             cases_expression="count(edad)")
        return measures.indicator(t.residents(spark, d), spec)
    return run


for _name, _text in EXPRESSIONS.items():
    _expression(_name, _text)


@query("expression_sum_ratio", with_views("fichas") + f"""
SELECT {DEP} AS geo_code, round(100.0 * sum(dev_h) / nullif(sum(pob_total_h), 0), 4) AS valor
FROM fichas GROUP BY 1""")
def expression_sum_ratio(spark, d):
    text = "round(100D * sum(dev_h) / nullif(sum(pob_total_h), 0), 4)"
    return measures.indicator(t.sheets(spark, d), IndicatorSpec(expression=text))


@query("expression_reference", with_views("residentes") + """
SELECT round(100.0 * count(*) FILTER (WHERE edad < 15) / count(*), 6) AS valor,
       count(*) AS casos FROM residentes WHERE idep = 0""")
def expression_reference(spark, d):
    spec = IndicatorSpec(department="0", cases_expression="count(*)",
                         expression="round(100D * count_if(edad < 15) / count(*), 6)")
    return measures.reference_value(t.residents(spark, d), spec)


# --- sheets -----------------------------------------------------------------------

@query("sheet_total", with_views("fichas") + f"""
SELECT {DEP} AS geo_code, CAST(sum(dev_h) AS DOUBLE) AS valor,
       CAST(sum(dev_h) AS BIGINT) AS casos FROM fichas GROUP BY 1""")
def sheet_total(spark, d):
    spec = IndicatorSpec("departamento", "total", "dev_h")
    return sheets.sheet_indicator(t.sheets(spark, d), spec, "dev_h")


@query("sheet_percentage", with_views("fichas") + f"""
SELECT {MUN} AS geo_code, round(100.0 * sum(dev_h) / nullif(sum(pob_total_h), 0), 2) AS valor,
       CAST(sum(pob_total_h) AS BIGINT) AS casos FROM fichas GROUP BY 1""")
def sheet_percentage(spark, d):
    spec = IndicatorSpec("municipio", "porcentaje", "dev_h")
    return sheets.sheet_indicator(t.sheets(spark, d), spec, "dev_h", "pob_total_h")


@query("sheet_units_of_municipality", with_views("fichas") + """
SELECT codigo AS geo_code, round(100.0 * sum(ace_m) / nullif(sum(pob_total_m), 0), 2) AS valor,
       CAST(sum(pob_total_m) AS BIGINT) AS casos FROM fichas
WHERE idep = 2 AND iprov = 7 AND imun = 1 AND area = 1 GROUP BY 1""")
def sheet_units_of_municipality(spark, d):
    spec = IndicatorSpec("unidad", "porcentaje", "ace_m", municipality="020701",
                         area="urbana")
    return sheets.sheet_indicator(t.sheets(spark, d), spec, "ace_m", "pob_total_m")


@query("sheet_reference", with_views("fichas") + """
SELECT round(100.0 * sum(ace_h) / nullif(sum(pob_total_h), 0), 2) AS valor,
       CAST(sum(pob_total_h) AS BIGINT) AS casos FROM fichas WHERE area = 2""")
def sheet_reference(spark, d):
    spec = IndicatorSpec("unidad", "porcentaje", "ace_h", area="rural")
    return sheets.sheet_reference(t.sheets(spark, d), spec, "ace_h", "pob_total_h")


@query("sheet_pairs", with_views("fichas") + f"""
SELECT {DEP} AS geo_code,
       round(100.0 * sum(dev_h + dev_m) / nullif(sum(pob_total_h + pob_total_m), 0), 2)
         AS valor, CAST(sum(pob_total_h + pob_total_m) AS BIGINT) AS casos
FROM fichas GROUP BY 1""")
def sheet_pairs(spark, d):
    rows = sheets.derive_pairs(t.sheets(spark, d))
    spec = IndicatorSpec("departamento", "porcentaje", "dev")
    return sheets.sheet_indicator(rows, spec, "dev", "pob_total")


@query("sheet_flag", with_views("fichas") + f"""
SELECT {MUN} AS geo_code, round(100.0 * count(*) FILTER (WHERE ficha) / count(*), 2) AS valor,
       count(*) AS casos FROM fichas GROUP BY 1""")
def sheet_flag(spark, d):
    from comarca.fixed_values import SPECIAL_EXPRESSIONS
    spec = IndicatorSpec("municipio", "porcentaje", "ficha")
    return sheets.sheet_indicator(t.sheets(spark, d), spec, *SPECIAL_EXPRESSIONS["ficha"])


SHEET_BATCH = {"dev_h": ("dev_h", "pob_total_h"), "ace_m": ("ace_m", "pob_total_m"),
               "dev": ("(dev_h + dev_m)", "(pob_total_h + pob_total_m)"),
               "personas": ("personas", None)}


@query("sheet_batch", with_views("fichas") + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, {MUN} AS geo_code, round(100.0 * sum({e}) / "
    f"nullif(sum({den}), 0), 2) AS valor, CAST(sum({den}) AS BIGINT) AS casos "
    "FROM fichas GROUP BY ALL" for v, (e, den) in SHEET_BATCH.items() if den))
def sheet_batch(spark, d):
    spec = IndicatorSpec("municipio", "porcentaje", "lote")
    return sheets.sheet_batch(t.sheets(spark, d), spec, SHEET_BATCH)


# --- coverage, distinct values, batches ----------------------------------------------

@query("coverage_by_department", with_views("personas") + " UNION ALL ".join(
    f"SELECT idep, '{c}' AS variable, count(*) AS n_total, count({c}) AS n_valid"
    " FROM personas GROUP BY idep" for c in ("agro", "hijos", "edad")))
def coverage_by_department(spark, d):
    return measures.coverage(t.persons(spark, d), ["agro", "hijos", "edad"], ["idep"])


@query("distinct_values", with_views("personas") + """
SELECT variable, valor, count(*) OVER (PARTITION BY variable) AS n_valores FROM (
  SELECT DISTINCT 'segmento' AS variable, segmento AS valor FROM personas
  UNION ALL SELECT DISTINCT 'anios_texto', anios_texto FROM personas
  UNION ALL SELECT DISTINCT 'persona', CAST(persona AS VARCHAR) FROM personas)""")
def distinct_values(spark, d):
    people = t.persons(spark, d)
    parts = [measures.distinct_values(people, v).select(F.lit(v).alias("variable"), "*")
             for v in ("segmento", "anios_texto", "persona")]
    return reduce(lambda a, b: a.unionByName(b), parts)


BATCH = {
    "conteo": (dict(), "CAST(count(*) AS DOUBLE)", "count(*)"),
    "edad_media": (dict(measure="mean", variable="edad"), "round(avg(edad), 4)",
                   "count(edad)"),
    "hijos_desv": (dict(measure="std", variable="hijos"), "round(stddev(hijos), 4)",
                   "count(hijos)"),
    "ingreso_mediana": (dict(measure="median", variable="ingreso"),
                        "round(median(ingreso), 4)", "count(ingreso)"),
    "edad_mediana": (dict(measure="median", variable="edad"),
                     "round(median(CAST(edad AS DOUBLE)), 4)", "count(edad)"),
    "urgente": (dict(measure="pct_category", variable="prioridad", category="1"),
                "round(100.0 * count(*) FILTER (WHERE prioridad_num = 1) / count(*), 2)",
                "count(*)"),
}


@query("indicator_batch", with_views("personas") + " UNION ALL ".join(
    f"SELECT '{name}' AS indicador, {MUN} AS geo_code, {v} AS valor, {c} AS casos "
    "FROM personas GROUP BY ALL" for name, (_, v, c) in BATCH.items()))
def indicator_batch(spark, d):
    specs = {name: IndicatorSpec("municipio", **kw) for name, (kw, _, _) in BATCH.items()}
    return measures.indicator_batch(t.persons(spark, d), specs)


# Twenty municipalities × three measures, beside two levels over everything: one aggregation.
MANY = tuple(f"0000{i:02d}" for i in range(1, 21))
OVER_TERRITORIES = {
    "ingreso_medio": (dict(measure="mean", variable="ingreso"), "round(avg(ingreso), 4)", "count(ingreso)"),
    "edad_desv": (dict(measure="std", variable="edad"), "round(stddev(edad), 4)", "count(edad)"),
    "jovenes": (dict(measure="pct_category", variable="sexo", category="1"),
                "round(100.0 * count(*) FILTER (WHERE sexo = 1) / count(*), 2)", "count(*)"),
}
WIDE = {
    "conteo_dep": (dict(level="departamento"), DEP, "TRUE", "CAST(count(*) AS DOUBLE)", "count(*)"),
    "edad_media_mun": (dict(level="municipio", department="0", measure="mean", variable="edad"), MUN, "idep = 0",
                       "round(avg(edad), 4)", "count(edad)"),
    "edad_mediana_dep": (dict(level="departamento", measure="median", variable="edad"), DEP, "TRUE",
                         "round(median(CAST(edad AS DOUBLE)), 4)", "count(edad)"),
    "ingreso_mediana_mun": (dict(level="municipio", municipality="000007", measure="median", variable="ingreso"), MUN,
                            "idep = 0 AND iprov = 0 AND imun = 7", "round(median(ingreso), 4)", "count(ingreso)"),
    "libre_dep": (dict(level="departamento", expression="round(100D * count_if(edad < 15) / count(*), 6)", cases_expression="count(*)"),
                  DEP, "TRUE", "round(100.0::DOUBLE * count(*) FILTER (WHERE edad < 15) / count(*), 6)", "count(*)"),
}


@query("batch_over_territories", with_views("residentes") + " UNION ALL ".join(
    [f"SELECT '{name}-' || {MUN} AS indicador, {MUN} AS geo_code, {v} AS valor, {c} AS casos FROM residentes "
     "WHERE idep = 0 AND iprov = 0 AND imun BETWEEN 1 AND 20 GROUP BY ALL" for name, (_, v, c) in OVER_TERRITORIES.items()]
    + [f"SELECT '{name}', {code}, {v}, {c} FROM residentes WHERE {where} GROUP BY ALL" for name, (_, code, where, v, c) in WIDE.items()]))
def batch_over_territories(spark, d):
    specs = {f"{name}-{code}": IndicatorSpec("municipio", municipality=code, **kw)
             for name, (kw, _, _) in OVER_TERRITORIES.items() for code in MANY}
    specs |= {name: IndicatorSpec(**kw) for name, (kw, *_) in WIDE.items()}
    return measures.indicator_batch(t.residents(spark, d), specs)


LEVELS = {"municipio": MUN, "departamento": DEP, "total": "NULL::VARCHAR"}


@query("approximate_quantiles", with_views("residentes") + " UNION ALL ".join(
    f"SELECT '{level}' AS nivel, {code} AS geo_code, {p}::DOUBLE AS prob, count(*) AS casos, "
    f"round(quantile_cont(ingreso, {p}), 4) AS exacto, TRUE AS dentro FROM residentes GROUP BY ALL"
    for level, code in LEVELS.items() for p in (0.5, 0.9)))
def approximate_quantiles(spark, d):
    """One sketch, three levels, beside the exact quantiles: within one per cent everywhere."""
    rows, accuracy, probs = t.residents(spark, d), 0.01, [0.5, 0.9]
    near = measures.approximate_quantiles(rows, IndicatorSpec("municipio", "median", "ingreso"), probs, accuracy)
    geo = GeoColumns.of(rows)
    places = ["idep", "iprov", "imun"]
    codes = {"municipio": geo_code("municipio", geo), "departamento": geo_code("departamento", geo), "total": F.lit(None).cast("string")}
    groups = F.array(*[F.struct(F.lit(level).alias("l"), code.alias("g")) for level, code in codes.items()])
    exact = quantiles.Histogram(rows, places, F.col("ingreso")).quantiles(groups, ["l", "g"], probs)
    exact = exact.select("l", "g", F.get(F.array(*map(F.lit, probs)), F.col("i")).alias("p"), "q")
    inside = F.abs(F.col("valor") - F.col("q")) <= accuracy * F.abs("q") + F.abs("q") * 1e-12
    return (near.join(exact, (F.col("nivel") == F.col("l")) & F.col("geo_code").eqNullSafe(F.col("g")) & (F.col("prob") == F.col("p")))
            .select("nivel", "geo_code", "prob", "casos", F.round("q", 4).alias("exacto"), inside.alias("dentro")))


@query("skewed_unit_median", """
SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'centro' ELSE CAST(l_suppkey AS VARCHAR) END
         AS geo_code, round(median(l_extendedprice), 4) AS valor,
       count(l_extendedprice) AS casos FROM lineitem GROUP BY 1""")
def skewed_unit_median(spark, d):
    unit = F.when(F.col("l_orderkey") % 3 == 0, "centro").otherwise(
        F.col("l_suppkey").cast("string"))
    rows = t.read(spark, d, "lineitem").withColumn("codigo", unit)
    return measures.indicator(rows, IndicatorSpec("unidad", "median", "l_extendedprice"),
                              GeoColumns(unit="codigo"))


@query("modal_frequencies", f"WITH r AS ({_mode_sql(MUN, 'edad')}" + """)
SELECT valor, valor AS texto, n, CAST(floor(100.0 * n / total) AS BIGINT) AS barra FROM (
  SELECT CAST(valor AS VARCHAR) AS valor, count(*) AS n, sum(count(*)) OVER () AS total
  FROM r GROUP BY 1) ORDER BY n DESC, valor LIMIT 12""")
def modal_frequencies(spark, d):
    result = _run(spark, d, measure="mode", variable="edad")
    return classify.modal_frequencies(result).withColumn("barra", F.col("barra").cast("bigint"))


@query("report_expression", with_views("personas") + f"""
SELECT es_total, geo_code, valor, casos, casos AS n_total, casos AS n_valid FROM (
  SELECT FALSE AS es_total, {MUN} AS geo_code, round(sum(ingreso) / count(*), 4) AS valor,
         count(*) AS casos FROM personas GROUP BY ALL
  UNION ALL SELECT TRUE, NULL, round(sum(ingreso) / count(*), 4), count(*) FROM personas)""")
def report_expression(spark, d):
    spec = IndicatorSpec("municipio", expression="round(sum(ingreso) / count(*), 4)", cases_expression="count(*)")
    return measures.indicator_report(t.persons(spark, d), spec)


# Holistic aggregates inside expressions, over a unit that holds a third of all rows.
@query("expression_of_holistic_parts", """
SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'centro' ELSE CAST(l_suppkey AS VARCHAR) END AS geo_code,
       round(median(l_extendedprice) / avg(l_quantity) + count(DISTINCT l_partkey)
             + quantile_cont(l_discount, 0.25) FILTER (WHERE l_tax > 0.02), 4) AS valor, count(DISTINCT l_orderkey) AS casos
FROM lineitem GROUP BY 1""")
def expression_of_holistic_parts(spark, d):
    unit = F.when(F.col("l_orderkey") % 3 == 0, "centro").otherwise(F.col("l_suppkey").cast("string"))
    rows = t.read(spark, d, "lineitem").withColumn("codigo", unit)
    spec = IndicatorSpec("unidad", cases_expression="count(DISTINCT l_orderkey)",
                         expression="round(median(l_extendedprice) / avg(l_quantity) + count(DISTINCT l_partkey)"
                                    " + percentile(l_discount, 0.25) FILTER (WHERE l_tax > 0.02), 4)")
    return measures.indicator(rows, spec, GeoColumns(unit="codigo"))


@query("batch_with_mode_and_expression", with_views("personas") + f"""
SELECT 'conteo' AS indicador, {MUN} AS geo_code, CAST(count(*) AS DOUBLE) AS valor, count(*) AS casos,
       NULL::VARCHAR AS categoria FROM personas GROUP BY ALL
UNION ALL SELECT 'por_fila', {MUN}, round(sum(ingreso) / count(*), 4), count(ingreso), NULL FROM personas GROUP BY ALL
UNION ALL SELECT 'moda', geo_code, NULL, casos, categoria FROM (
  SELECT {MUN} AS geo_code, CAST(hijos AS VARCHAR) AS categoria,
         CAST(sum(count(*)) OVER (PARTITION BY {MUN}) AS BIGINT) AS casos,
         row_number() OVER (PARTITION BY {MUN} ORDER BY count(*) DESC, hijos) AS lugar
  FROM personas WHERE hijos IS NOT NULL GROUP BY {MUN}, hijos) WHERE lugar = 1""")
def batch_with_mode_and_expression(spark, d):
    specs = {"conteo": IndicatorSpec("municipio"), "moda": IndicatorSpec("municipio", "mode", "hijos"),
             "por_fila": IndicatorSpec("municipio", expression="round(sum(ingreso) / count(*), 4)", cases_expression="count(ingreso)")}
    return measures.indicator_batch(t.persons(spark, d), specs)
