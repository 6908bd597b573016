"""Dictionaries, labels, catalogues, documentation and questionnaire skips."""

from __future__ import annotations

from pyspark.sql import functions as F

from comarca.fixed_values import SKIP_PATTERN
from comarca.operators import catalogue, codebook, measures, quality, skips
from comarca.spec import IndicatorSpec
from workload import tables as t
from workload.registry import query
from workload.tables import MUN, with_views


def _dictionary(spark, d, table="personas"):
    return codebook.variable_dictionary(t.variable_rows(spark, d), table)


@query("variable_dictionary", with_views("variables") + """
SELECT variable, label, tipo, universo, tema, tema_etiqueta FROM variables
WHERE entidad = 'POBLACION'""")
def variable_dictionary(spark, d):
    rows = _dictionary(spark, d)
    return rows.withColumn("universo", F.lower("universo"))


# Brand and size name a variable, so names repeat; the part with the highest key is the last.
@query("dictionary_with_repeated_names", """
SELECT variable, label, tipo, universo, tema, tema_etiqueta FROM (
  SELECT lower(replace(p_brand, '#', '_')) || '_' || CAST(p_size AS VARCHAR) AS variable, p_name AS label,
         lower(p_type) AS tipo, p_name AS universo, lower(p_type) AS tema, p_type AS tema_etiqueta, p_partkey
  FROM part) QUALIFY row_number() OVER (PARTITION BY variable ORDER BY p_partkey DESC) = 1""")
def dictionary_with_repeated_names(spark, d):
    name = F.concat(F.lower(F.translate("p_brand", "#", "_")), F.lit("_"), F.col("p_size").cast("string"))
    rows = t.read(spark, d, "part").select(
        name.alias("variable"), F.col("p_name").alias("descripcion"), F.col("p_type").alias("type"),
        F.col("p_name").alias("universo"), F.lower("p_type").alias("tema"),
        F.col("p_type").alias("tema_etiqueta"), F.col("p_partkey").alias("fila"))
    return codebook.variable_dictionary(rows, order=F.col("fila"))


@query("variable_dictionary_unfiltered", with_views("variables") + """
SELECT count(*) AS n, count(DISTINCT variable) AS variables FROM variables""")
def variable_dictionary_unfiltered(spark, d):
    return _dictionary(spark, d, "mortalidad").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("variable").alias("variables"))


@query("variable_descriptions_and_types", with_views("variables") + """
SELECT variable, label, tipo FROM variables WHERE label <> '' AND entidad = 'VIVIENDA'""")
def variable_descriptions_and_types(spark, d):
    rows = _dictionary(spark, d, "viviendas")
    return codebook.descriptions(rows).join(codebook.types(rows), "variable")


@query("variable_universes", with_views("variables") + """
SELECT variable, CASE WHEN universo = 'todas_personas' THEN 'todas las personas'
    WHEN universo LIKE 'personas%' THEN 'personas de ' || split_part(universo, '_', 2)
         || ' años o más'
    WHEN universo LIKE 'mujeres%' THEN 'mujeres de 15 a ' || split_part(universo, '_', 3)
         || ' años'
    ELSE replace(universo, '_', ' ') END AS universo
FROM variables WHERE universo IS NOT NULL""")
def variable_universes(spark, d):
    return codebook.universes(_dictionary(spark, d, None))


@query("variable_themes", with_views("variables") + """
SELECT variable, tema, coalesce(tema_etiqueta, upper(substr(tema, 1, 1))
       || substr(replace(tema, '_', ' '), 2)) AS tema_etiqueta
FROM variables WHERE tema IS NOT NULL""")
def variable_themes(spark, d):
    return codebook.themes(_dictionary(spark, d, None))


@query("theme_counts", with_views("variables") + """
SELECT tema, max(coalesce(tema_etiqueta, upper(substr(tema, 1, 1))
       || substr(replace(tema, '_', ' '), 2))) AS tema_etiqueta, count(*) AS n
FROM variables WHERE tema IS NOT NULL GROUP BY tema""")
def theme_counts(spark, d):
    return codebook.theme_counts(_dictionary(spark, d, None))


_LABELS = """
SELECT variable, valor, etiqueta FROM etiquetas e
WHERE entidad = 'PERSONA' OR variable NOT IN (
  SELECT variable FROM etiquetas WHERE entidad = 'PERSONA')
QUALIFY row_number() OVER (PARTITION BY variable, valor ORDER BY fila DESC) = 1"""


def _labels(spark, d, **kw):
    return codebook.value_labels(t.label_rows(spark, d), "personas", order=F.col("fila"), **kw)


@query("value_labels", with_views("etiquetas") + _LABELS)
def value_labels(spark, d):
    return _labels(spark, d)


@query("results_with_labels", with_views("personas", "etiquetas").rstrip() + f""",
lab AS ({_LABELS})
SELECT p.valor, p.n, etiqueta,
       CASE WHEN etiqueta IS NULL THEN p.valor ELSE p.valor || ' — ' || etiqueta END AS texto
FROM (SELECT lpad(CAST(hijos AS VARCHAR), 3, '0') AS valor, hijos, count(*) AS n
      FROM personas WHERE hijos IS NOT NULL GROUP BY 1, 2) p
LEFT JOIN lab ON lab.valor = CAST(p.hijos AS VARCHAR) AND lab.variable = 'var_1'""")
def results_with_labels(spark, d):
    code = F.lpad(F.col("hijos").cast("string"), 3, "0").alias("valor")
    counts = (t.persons(spark, d).filter("hijos IS NOT NULL").groupBy(code)
              .agg(F.count(F.lit(1)).alias("n")))
    return codebook.with_value_labels(counts, "valor", _labels(spark, d, variable="VAR_1"))


@query("category_list", with_views("etiquetas").rstrip() + f""",
lab AS ({_LABELS})
SELECT 'var_2' AS variable, valor, valor || ' — ' || etiqueta AS texto FROM lab
WHERE variable = 'var_2'
UNION ALL SELECT DISTINCT 'c_mktsegment', c_mktsegment, c_mktsegment FROM customer""")
def category_list(spark, d):
    labels, customer = _labels(spark, d), t.read(spark, d, "customer")
    known = codebook.category_list(customer.withColumn("var_2", F.lit(1)), "var_2", labels)
    found = codebook.category_list(customer, "c_mktsegment", labels)
    return (known.select(F.lit("var_2").alias("variable"), "*")
            .unionByName(found.select(F.lit("c_mktsegment").alias("variable"), "*")))


# --- catalogue ----------------------------------------------------------------------

_CATALOGUE = """
SELECT tabla, variable, etiqueta, bloque, bloque_etiqueta, tipo, variable AS expr,
       denominador, tema, tema_etiqueta FROM cat_origen
UNION ALL
SELECT h.tabla, h.base, regexp_replace(h.etiqueta, ', hombres$', ''), h.bloque,
       h.bloque_etiqueta, h.tipo, '(' || h.base || '_h + ' || h.base || '_m)',
       '(tot_h + tot_m)', h.tema, h.tema_etiqueta
FROM cat_origen h JOIN cat_origen m ON h.base = m.base AND h.suf = '_h' AND m.suf = '_m'"""


@query("catalogue_with_derived_pairs", with_views("cat_origen") + _CATALOGUE)
def catalogue_with_derived_pairs(spark, d):
    return catalogue.build_catalogue(t.catalogue_source(spark, d))


@query("catalogue_order", with_views("cat_origen").rstrip() + f""",
cat AS ({_CATALOGUE})
SELECT tabla, variable, CASE WHEN bloque = 'b5' THEN 99
         ELSE CAST(substr(bloque, 2) AS BIGINT) END AS bloque_orden,
       regexp_replace(variable, '_[hm]$', '') AS base,
       CASE WHEN variable LIKE '%\\_h' ESCAPE '\\' THEN 1::BIGINT
            WHEN variable LIKE '%\\_m' ESCAPE '\\' THEN 2 ELSE 0 END AS sexo FROM cat""")
def catalogue_order(spark, d):
    rows = catalogue.catalogue_rows(t.catalogue_source(spark, d))
    everything = rows.unionByName(catalogue.derive_pair_rows(rows))
    keys = {name: key.cast("bigint") if name in ("bloque_orden", "sexo") else key
            for name, key in catalogue.catalogue_sort_keys().items()}
    return (everything.withColumns(keys).select("variable", *keys)
            .orderBy("bloque_orden", "tabla", "base", "sexo"))


@query("catalogue_lookup", with_views("cat_origen").rstrip() + f""",
cat AS ({_CATALOGUE})
SELECT tabla, variable, CASE WHEN bloque_etiqueta <> '' THEN bloque_etiqueta ELSE bloque END
         AS bloque_etiqueta, expr, denominador <> '' AS tiene_porcentaje
FROM cat WHERE tabla = 'fichas' AND variable IN ('i7', 'i7_t', 'i10_h')""")
def catalogue_lookup(spark, d):
    built = catalogue.build_catalogue(t.catalogue_source(spark, d))
    found = [catalogue.find_indicator(built, "fichas", v) for v in ("i7", "i7_t", "i10_h")]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.select("tabla", "variable", "bloque_etiqueta", "expr", "tiene_porcentaje")


# The catalogue of a year: a column per part shipped in it, its denominator from its shipments.
def _catalogue_of_year(spark, d, year):
    shipped = t.read(spark, d, "lineitem").filter(F.year("l_shipdate") == year).groupBy("l_partkey").agg(
        F.min("l_returnflag").alias("flag"))
    part = t.read(spark, d, "part").join(shipped, F.col("p_partkey") == F.col("l_partkey"))
    block = F.concat(F.lit("b"), (F.col("p_size") % 7).cast("string"))
    return catalogue.build_catalogue(part.select(
        F.when(F.col("p_partkey") % 3 == 0, "unidad").otherwise("ficha").alias("tabla"),
        F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("variable"),
        F.col("p_name").alias("etiqueta"), block.alias("bloque"), block.alias("bloque_etiqueta"),
        F.lit("numerica").alias("tipo"), F.concat(F.lit("tot_"), F.lower("flag")).alias("denominador"),
        F.lower("p_type").alias("tema"), F.col("p_type").alias("tema_etiqueta"),
        (F.col("p_size") % 7).alias("bloque_orden")))


@query("catalogue_changes", """
WITH cat AS (
  SELECT year(l_shipdate) AS anio, CASE WHEN p_partkey % 3 = 0 THEN 'unidades' ELSE 'fichas' END AS tabla,
         'i' || CAST(p_partkey AS VARCHAR) AS variable, 'tot_' || lower(min(l_returnflag)) AS denominador
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
old AS (SELECT * FROM cat WHERE anio = 1995), new AS (SELECT * FROM cat WHERE anio = 1996)
SELECT coalesce(o.tabla, n.tabla) AS tabla, coalesce(o.variable, n.variable) AS variable,
       CASE WHEN o.tabla IS NULL THEN 'nueva' WHEN n.tabla IS NULL THEN 'eliminada'
            ELSE 'cambiada' END AS cambio
FROM old o FULL OUTER JOIN new n ON o.tabla = n.tabla AND o.variable = n.variable
WHERE o.tabla IS NULL OR n.tabla IS NULL OR o.denominador <> n.denominador""")
def catalogue_changes(spark, d):
    return catalogue.catalogue_diff(_catalogue_of_year(spark, d, 1995), _catalogue_of_year(spark, d, 1996))


# --- documentation and skips --------------------------------------------------------

def _docs(spark, d):
    return codebook.clean_docs(t.doc_rows(spark, d))


@query("clean_documentation", with_views("docs") + "SELECT * FROM docs")
def clean_documentation(spark, d):
    return codebook.in_key_order(_docs(spark, d))


@query("duplicate_documentation", """
SELECT anio, tabla, variable, count(*) AS n FROM (
  SELECT 2024 AS anio, role AS tabla, 'v' || CAST(turn AS VARCHAR) AS variable
  FROM conversations) GROUP BY ALL HAVING count(*) > 1""")
def duplicate_documentation(spark, d):
    rows = t.read(spark, d, "conversations").select(
        F.lit(2024).alias("anio"), F.col("role").alias("tabla"),
        F.concat(F.lit("v"), F.col("turn").cast("string")).alias("variable"))
    return codebook.duplicate_doc_keys(rows)


@query("documentation_lookup", """
WITH found AS (
  SELECT 2024 AS anio, 'v' || CAST(conv_id AS VARCHAR) AS variable, turn, text,
         CASE turn % 4 WHEN 0 THEN 'discapacidad' WHEN 1 THEN 'persona'
              WHEN 2 THEN 'vivienda' ELSE 'zona' END AS doc_tabla
  FROM conversations),
ranked AS (
  SELECT anio, w.tabla, variable, doc_tabla, text AS definicion, row_number() OVER (
    PARTITION BY variable, w.tabla ORDER BY CASE
      WHEN w.tabla = 'personas' AND doc_tabla = 'persona' THEN 0
      WHEN w.tabla = 'personas' AND doc_tabla = 'discapacidad' THEN 2
      WHEN w.tabla = 'viviendas' AND doc_tabla = 'vivienda' THEN 0 ELSE 3 END,
      doc_tabla, text) AS lugar
  FROM found, (VALUES ('personas'), ('viviendas'), ('mortalidad')) AS w(tabla))
SELECT anio, tabla, variable, doc_tabla, definicion FROM ranked WHERE lugar = 1""")
def documentation_lookup(spark, d):
    rows = t.read(spark, d, "conversations")
    kind = F.element_at(F.array(*map(F.lit, ("discapacidad", "persona", "vivienda", "zona"))),
                        (F.col("turn") % 4 + 1).cast("int"))
    docs = rows.select(F.lit(2024).alias("anio"), kind.alias("tabla"),
                       F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("variable"),
                       F.col("text").alias("definicion"), F.lit("").alias("pregunta_literal"),
                       F.lit("").alias("universo_literal"), F.lit("").alias("regla_derivacion"))
    asked = F.explode(F.array(*map(F.lit, ("personas", "viviendas", "mortalidad"))))
    wanted = docs.select("anio", "variable").distinct().select("*", asked.alias("tabla"))
    return codebook.find_docs(docs, wanted).select("anio", "tabla", "variable", "doc_tabla", "definicion")


_SKIPS = with_views("docs").rstrip() + f""",
q AS (SELECT *, CAST(regexp_extract(pregunta_literal, '^\\s*(\\d+)\\s*[.)]', 1) AS BIGINT) AS num
      FROM docs),
m AS (SELECT tabla, variable, num, unnest(regexp_extract_all(pregunta_literal,
             '(?i){SKIP_PATTERN}')) AS s,
             generate_subscripts(regexp_extract_all(pregunta_literal,
             '(?i){SKIP_PATTERN}'), 1) AS pos FROM q),
o AS (SELECT tabla, num, pos,
        CAST(regexp_extract(s, '(?i){SKIP_PATTERN}', 1) AS BIGINT) AS codigo,
        trim(regexp_extract(s, '(?i){SKIP_PATTERN}', 2), ' .,;:') AS texto,
        CAST(regexp_extract(s, '(?i){SKIP_PATTERN}', 3) AS BIGINT) AS destino FROM m),
opciones AS (SELECT tabla, num, codigo, destino, min(pos) AS pos,
        CASE WHEN texto LIKE '%¿%' OR length(texto) > 40 THEN '' ELSE texto END AS respuesta
      FROM o GROUP BY ALL),
e1 AS (SELECT tabla, num, trim(regexp_replace(pregunta_literal, '^\\s*\\d+\\s*[.)]', ''))
        AS t FROM q),
e2 AS (SELECT tabla, num, t, CASE WHEN instr(t, '?') > 1 THEN instr(t, '?') ELSE 1000000000 END
        AS a, CASE WHEN instr(t, ':') > 1 THEN instr(t, ':') ELSE 1000000000 END AS c FROM e1),
e3 AS (SELECT tabla, num, trim(CASE WHEN least(a, c) = 1000000000 THEN t
        WHEN a < c THEN substr(t, 1, a) ELSE substr(t, 1, c - 1) END, ' .,;:') AS t FROM e2),
enunciados AS (SELECT tabla, num, CASE WHEN length(t) <= 90 THEN t
        ELSE regexp_replace(substr(t, 1, 90), ' [^ ]*$', '') || '…' END AS pregunta FROM e3)
"""


@query("question_statements", _SKIPS + """
SELECT tabla, num, pregunta FROM enunciados""")
def question_statements(spark, d):
    docs = _docs(spark, d)
    text = F.col("pregunta_literal")
    return docs.select("tabla", skips.question_number(text).alias("num"),
                       skips.short_statement(text).alias("pregunta"))


@query("skip_options", _SKIPS + """
SELECT tabla, num, codigo, respuesta, destino FROM opciones""")
def skip_options(spark, d):
    return skips.skip_options(_docs(spark, d)).select("tabla", "num", "codigo", "respuesta",
                                                      "destino")


_CLAUSES = _SKIPS.rstrip() + """,
pares AS (SELECT q.tabla, q.num, p.num AS previa, p.codigo, p.respuesta, p.pos
          FROM q JOIN opciones p ON q.tabla = p.tabla AND p.num < q.num
                                 AND p.destino > q.num),
clausulas AS (SELECT p.tabla, p.num, previa, coalesce(
      string_agg('«' || respuesta || '»', ' o ' ORDER BY pos) FILTER (WHERE respuesta <> ''),
      string_agg('el código ' || CAST(codigo AS VARCHAR), ' o ' ORDER BY pos))
      || ' en la pregunta ' || CAST(previa AS VARCHAR) || ' («' || pregunta || '»)' AS c
    FROM pares p JOIN enunciados e ON e.tabla = p.tabla AND e.num = p.previa
    GROUP BY p.tabla, p.num, previa, pregunta),
frases AS (SELECT tabla, num, 'no a quienes respondieron '
      || string_agg(c, ' ni ' ORDER BY previa)
      || ': el cuestionario les salta esta pregunta' AS frase FROM clausulas
      GROUP BY tabla, num)
"""


@query("prior_conditions", _CLAUSES + """
SELECT tabla, num, previa, c AS clausula FROM clausulas""")
def prior_conditions(spark, d):
    found = skips.prior_conditions(_docs(spark, d))
    clause = skips.condition_clause(F.col("previa"), F.col("pregunta"), F.col("respuestas"))
    return found.select("tabla", "num", "previa", clause.alias("clausula"))


@query("condition_phrases", _CLAUSES + """
SELECT q.anio, q.tabla, q.variable, q.num, frase FROM q JOIN frases USING (tabla, num)""")
def condition_phrases(spark, d):
    return skips.variable_phrases(_docs(spark, d))


@query("help_texts", _CLAUSES + """
SELECT q.anio, q.tabla, q.variable, concat_ws(chr(10) || chr(10),
  CASE WHEN definicion <> '' THEN CASE WHEN length(definicion) <= 600 THEN definicion ELSE
       regexp_replace(substr(definicion, 1, 600), ' [^ ]*$', '') || '…' END END,
  CASE WHEN pregunta_literal <> '' THEN 'Pregunta en campo: «' || pregunta_literal || '»' END,
  CASE WHEN universo_literal <> '' THEN 'Se aplicó a: ' || universo_literal END,
  CASE WHEN universo_literal <> '' THEN 'Y, dentro de ese universo, ' ELSE 'Pero ' END
       || frase || '.',
  CASE WHEN regla_derivacion <> '' THEN 'Cómo se construyó: ' || CASE
       WHEN length(regla_derivacion) <= 600 THEN regla_derivacion ELSE
       regexp_replace(substr(regla_derivacion, 1, 600), ' [^ ]*$', '') || '…' END END)
  AS ayuda
FROM q LEFT JOIN frases USING (tabla, num)""")
def help_texts(spark, d):
    return skips.help_text(_docs(spark, d))


@query("missing_explained", with_views("personas") + """
SELECT idep, count(*) AS n_total, count(*) - count(hijos) AS n_sin_dato,
  count(*) FILTER (WHERE hijos IS NULL AND edad < 15) AS n_fuera,
  count(*) FILTER (WHERE hijos IS NULL AND edad >= 15 AND prioridad_num < 3) AS n_salto,
  count(*) FILTER (WHERE hijos IS NULL AND edad >= 15 AND prioridad_num >= 3) AS n_residuo
FROM personas GROUP BY idep""")
def missing_explained(spark, d):
    return skips.explain_missing(t.persons(spark, d), "hijos", F.col("edad") >= 15,
                                 F.col("prioridad_num") < 3, by=["idep"])


@query("universe_notes", _CLAUSES.rstrip() + ", " + with_views("variables").rstrip().removeprefix("WITH ") + """,
u AS (SELECT variable, CASE
    WHEN universo LIKE 'personas%' THEN 'personas de ' || split_part(universo, '_', 2)
         || ' años o más'
    WHEN universo LIKE 'mujeres%' THEN 'mujeres de 15 a ' || split_part(universo, '_', 3)
         || ' años' ELSE replace(universo, '_', ' ') END AS u
  FROM variables WHERE universo <> 'todas_personas'),
f AS (SELECT 'v' || CAST(CAST(substr(q.variable, 2) AS INT) AS VARCHAR) AS variable, min(frase) AS frase
      FROM q JOIN frases USING (tabla, num) GROUP BY 1)
SELECT coalesce(u.variable, f.variable) AS variable,
  CASE WHEN u IS NOT NULL AND frase IS NOT NULL THEN 'Pregunta aplicada a: ' || u
            || ' — y, dentro de ese universo, ' || frase || '.'
       WHEN u IS NOT NULL THEN 'Pregunta aplicada a: ' || u || '.'
       ELSE 'Esta pregunta no se hizo a todos: ' || frase || '.' END AS nota
FROM u FULL OUTER JOIN f ON u.variable = f.variable""")
def universe_notes(spark, d):
    # the questionnaire numbers its variables v0007, the dictionary v7; one sentence per variable
    phrases = skips.variable_phrases(_docs(spark, d)).groupBy(
        F.concat(F.lit("v"), F.expr("CAST(CAST(substring(variable, 2) AS INT) AS STRING)")).alias("variable")).agg(
        F.min("frase").alias("frase"))
    return quality.universe_notes(_dictionary(spark, d, None), phrases)


@query("mode_with_label", with_views("personas", "etiquetas").rstrip() + f""",
lab AS ({_LABELS}),
r AS (SELECT geo_code, valor FROM (
  SELECT {MUN} AS geo_code, hijos AS valor, row_number() OVER (
    PARTITION BY {MUN} ORDER BY count(*) DESC, hijos) AS lugar
  FROM personas WHERE hijos IS NOT NULL GROUP BY {MUN}, hijos) WHERE lugar = 1)
SELECT geo_code, CAST(r.valor AS VARCHAR)
       || coalesce(' — ' || etiqueta, '') AS texto
FROM r LEFT JOIN lab ON lab.valor = CAST(r.valor AS VARCHAR) AND variable = 'var_0'""")
def mode_with_label(spark, d):
    result = measures.indicator(t.persons(spark, d),
                                IndicatorSpec("municipio", "mode", "hijos"))
    labelled = codebook.with_value_labels(result, "valor", _labels(spark, d, variable="var_0"))
    return labelled.select("geo_code", "texto")


@query("legal_measures", with_views("variables") + """
SELECT variable, unnest(CASE tipo WHEN 'categorica' THEN ['pct_category', 'pct_total', 'mode']
  ELSE ['mean', 'median', 'sum', 'std'] END) AS medida FROM variables""")
def legal_measures(spark, d):
    return codebook.legal_measures(_dictionary(spark, d, None))
