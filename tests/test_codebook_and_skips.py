import random

import pytest
from pyspark.sql import functions as F

from comarca.operators import catalogue, codebook, quality, skips

DOCS = [
    (2024, "persona", "p43_pago", None, "43. La semana pasada, ¿trabajó por pago? "
     "1 Sí (PASE A P49) 2 No", "Personas de 7 años o más", None),
    (2024, "persona", "p44_nego", "", " 44)  ¿Atendió un negocio?\n 1 Sí ( PASE A 49 ) "
     "2 No 3 ¿La mayor parte para la venta? (pase a P. 46)", "", ""),
    (2024, "persona", "p45_agro", "d" * 30 + " " + "e" * 600, "45. ¿Atendió cultivos?: "
     "1 Sí (PASE A P47) 2 No", "Personas de 7 años o más", "regla"),
    (2024, "persona", "p46_dest", "x", "46. ¿Para qué?", "", ""),
    (2024, "persona", "p47_otro", "x", "47. Otro: 1 Sí 2 No", "", ""),
    (2024, "vivienda", "v46", "x", "46. ¿Techo? 1 Teja", "", ""),
    (2024, "vivienda", "v01", "x", "Sin número (PASE A 99)", "", ""),
]
KIND = ("anio int, tabla string, variable string, definicion string, "
        "pregunta_literal string, universo_literal string, regla_derivacion string")


@pytest.fixture(scope="module")
def docs(spark):
    return codebook.clean_docs(spark.createDataFrame(DOCS, KIND)).cache()


def test_question_parts(docs):
    rows = {r[0]: (r[1], r[2]) for r in docs.select(
        "variable", skips.question_number(F.col("pregunta_literal")),
        skips.short_statement(F.col("pregunta_literal"))).collect()}
    assert rows["p43_pago"] == (43, "La semana pasada, ¿trabajó por pago?")
    assert rows["p44_nego"] == (44, "¿Atendió un negocio?")
    assert rows["p47_otro"] == (47, "Otro")
    assert rows["v01"] == (None, "Sin número (PASE A 99)")


def test_skips_and_conditions(docs):
    options = {(r.num, r.codigo, r.respuesta, r.destino)
               for r in skips.skip_options(docs).collect()}
    assert options == {(43, 1, "Sí", 49), (44, 1, "Sí", 49), (44, 3, "", 46), (45, 1, "Sí", 47)}
    found = {}
    for r in skips.prior_conditions(docs).collect():
        found.setdefault((r.tabla, r.num), []).append(
            (r.previa, [(a.codigo, a.etiqueta) for a in r.respuestas]))
    assert sorted(found[("persona", 45)]) == [(43, [(1, "Sí")]), (44, [(1, "Sí"), (3, "")])]
    assert [j for j, _ in sorted(found[("persona", 46)])] == [43, 44, 45]
    assert 45 not in [j for j, _ in found[("persona", 47)]]
    assert ("vivienda", 46) not in found and ("persona", 43) not in found


def test_phrases_and_help(docs):
    text = {r.variable: r.frase for r in skips.variable_phrases(docs).collect()}
    assert text["p44_nego"] == (
        "no a quienes respondieron «Sí» en la pregunta 43 («La semana pasada, ¿trabajó por "
        "pago?»): el cuestionario les salta esta pregunta")
    assert " ni «Sí» en la pregunta 44 (" in text["p45_agro"]
    help_of = {r.variable: r.ayuda for r in skips.help_text(docs).collect()}
    lines = help_of["p45_agro"].split("\n\n")
    assert lines[0] == "d" * 30 + "…" and lines[2] == "Se aplicó a: Personas de 7 años o más"
    assert lines[3].startswith("Y, dentro de ese universo, no a quienes")
    assert lines[4] == "Cómo se construyó: regla"
    assert help_of["p46_dest"].split("\n\n")[2].startswith("Pero no a quienes")


def test_answer_without_words_is_cited_by_code(spark):
    rows = [(1, "t", "a", "", "1. ¿A? 2 ¿Otra? (PASE A 9)", "", ""),
            (1, "t", "b", "", "5. ¿B?", "", "")]
    got = skips.condition_phrases(spark.createDataFrame(rows, KIND)).collect()
    assert "el código 2 en la pregunta 1" in got[0].frase


def test_skip_ranges_far_apart(spark):
    rows = [(1, "t", f"v{n}", "", f"{n}. ¿Q? 1 Sí (PASE A {n + span})", "", "")
            for n, span in ((1, 10 ** 9), (2, 2), (500, 3), (502, 1), (10 ** 9, 7))]
    rows.append((1, "t", "end", "", f"{2 * 10 ** 9}. fin", "", ""))
    got = {(r.num, r.previa) for r in
           skips.prior_conditions(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {(2, 1), (500, 1), (502, 1), (10 ** 9, 1), (502, 500)}


def test_duplicate_docs(spark, docs):
    codebook.require_unique_docs(docs)
    with pytest.raises(ValueError):
        codebook.require_unique_docs(docs.unionByName(docs))


def test_find_docs_prefers_the_tables_own_names(spark, docs):
    extra = [(2024, "poblacion", "p46_dest", "otra", "", "", ""),
             (2024, "zona", "suelta", "z", "", "", "")]
    every = docs.unionByName(spark.createDataFrame(extra, KIND))
    wanted = spark.createDataFrame([(2024, "personas", "p46_dest"), (2024, "viviendas", "suelta"),
                                    (2012, "personas", "p46_dest")],
                                   "anio int, tabla string, variable string")
    got = {(r.tabla, r.variable): r.doc_tabla
           for r in codebook.find_docs(every, wanted).collect()}
    assert got == {("personas", "p46_dest"): "persona", ("viviendas", "suelta"): "zona"}


def test_labels_fall_back_per_variable(spark):
    raw = spark.createDataFrame(
        [(1, "P1", "1", "viejo", "PERSONA"), (2, "p1", "1", "nuevo", "persona"),
         (3, "p1", "2", "ajeno", "VIVIENDA"), (4, "P2", "1", "otra", "VIVIENDA")],
        "fila int, var string, code string, label string, tabla string")
    get = lambda t: {(r.variable, r.valor): r.etiqueta for r in codebook.value_labels(
        raw, t, order=F.col("fila")).collect()}
    assert get("personas") == {("p1", "1"): "nuevo", ("p2", "1"): "otra"}
    assert get(None) == {("p1", "1"): "nuevo", ("p1", "2"): "ajeno", ("p2", "1"): "otra"}
    area = codebook.sheet_value_labels(raw, "area").collect()
    assert {(r.valor, r.etiqueta) for r in area} == {("1", "Urbana"), ("2", "Rural")}


def test_dictionary_falls_back_whole(spark):
    raw = spark.createDataFrame([(" a ", "A", "Numerica", "PERSONA"), ("b", "", "x", "OTRA")],
                                "var string, desc string, tipo string, entidad string")
    names = lambda t: [r.variable for r in codebook.variable_dictionary(raw, t).collect()]
    assert names("personas") == ["a"] and names("viviendas") == ["a", "b"]
    assert codebook.types(codebook.variable_dictionary(raw)).first().tipo == "numerica"


def test_the_last_entry_of_a_variable_and_of_a_code_counts(spark):
    raw = spark.createDataFrame([(1, "a", "old", "PERSONA"), (3, "a", "new", "PERSONA"), (2, "a", "mid", "VIVIENDA")],
                                "fila int, var string, desc string, entidad string")
    pick = lambda *a: [(r.variable, r.label) for r in codebook.variable_dictionary(*a).collect()]
    assert pick(raw, None, F.col("fila")) == [("a", "new")]
    assert pick(raw, "viviendas", F.col("fila")) == [("a", "mid")]
    assert pick(raw) == [("a", "old")]                       # the greatest in its texts
    labels = spark.createDataFrame([(1, "1", "first"), (2, "01", "last")], "fila int, valor string, etiqueta string")
    codes = spark.createDataFrame([("001",)], "c string")
    assert codebook.with_value_labels(codes, "c", labels, order="fila").first().etiqueta == "last"


def test_category_list(spark):
    df = spark.createDataFrame([(str(i),) for i in (10, 9, 1)] + [("z",)], "c string")
    none = spark.createDataFrame([], "variable string, valor string, etiqueta string")
    assert [r.valor for r in codebook.category_list(df, "c", none).collect()] == \
        ["1", "9", "10", "z"]
    assert [r.valor for r in codebook.category_list(df, "c", none, limit=3).collect()] == ["1", "9", "10"]
    some = spark.createDataFrame([("c", "02", "Dos")],
                                 "variable string, valor string, etiqueta string")
    assert [r.texto for r in codebook.category_list(df, "C", some).collect()] == ["02 — Dos"]


def test_catalogue(spark):
    source = spark.createDataFrame(
        [("ficha", "pob_h", "Población, total, hombres", "b", "B", "", "tot_h", "t", "T", 2),
         ("ficha", "pob_m", "Población, total, mujeres", "b", "B", "", "tot_m", "t", "T", 2),
         ("ficha", "solo_h", "Solo, hombres", "a", "", "", "", "t", "T", 1),
         ("unidad", "ficha", "Con ficha", "c", "C", "", None, "t", "T", None),
         ("unidad", "codigo", "Código", "", "", "", "", "", "", None)],
        "tabla string, variable string, etiqueta string, bloque string, bloque_etiqueta "
        "string, tipo string, denominador string, tema string, tema_etiqueta string, "
        "bloque_orden int")
    built = catalogue.build_catalogue(source)
    rows = built.collect()
    assert [r.variable for r in rows] == ["solo_h", "pob", "pob_h", "pob_m", "ficha"]
    pob = rows[1]
    assert (pob.etiqueta, pob.expr, pob.denominador) == \
        ("Población, total", "(pob_h + pob_m)", "(tot_h + tot_m)")
    assert (rows[4].tabla, rows[4].expr, rows[4].denominador, rows[4].tipo) == \
        ("unidades", "CASE WHEN ficha THEN 1 ELSE 0 END", "1", "numerica")
    one = catalogue.find_indicator(built, "fichas", "solo_h").collect()[0]
    assert (one.bloque_etiqueta, one.tiene_porcentaje) == ("a", False)
    after = built.filter("variable <> 'pob'").withColumn("expr", F.when(
        F.col("variable") == "pob_m", "z").otherwise(F.col("expr")))
    assert {(r.variable, r.cambio) for r in catalogue.catalogue_diff(built, after).collect()} \
        == {("pob", "eliminada"), ("pob_m", "cambiada")}


def test_notes(spark, docs):
    dictionary = spark.createDataFrame(
        [("p45_agro", "personas_7_mas"), ("p46_dest", "todas_personas"), ("x", None)],
        "variable string, universo string")
    notes = {r.variable: r.nota for r in quality.universe_notes(
        dictionary, skips.variable_phrases(docs)).collect()}
    assert notes["p45_agro"].startswith(
        "Pregunta aplicada a: personas de 7 años o más — y, dentro de ese universo, no a")
    assert notes["p46_dest"].startswith("Esta pregunta no se hizo a todos: no a quienes")
    assert "x" not in notes


def test_a_stretch_of_any_length_is_a_few_blocks(spark):
    rng = random.Random(3)
    pairs = [(a, a + rng.choice([0, 1, 2, 5, 63, 64, 1000, 10 ** 6, 10 ** 17])) for a in (rng.randrange(1, 10 ** rng.randrange(1, 18)) for _ in range(200))]
    df = spark.createDataFrame(pairs, "a long, b long").select("*", skips._blocks("a", "b").alias("blocks"))
    for r in df.collect():
        parts = sorted((b.block << b.level, ((b.block + 1) << b.level) - 1) for b in r.blocks)
        assert parts[0][0] == r.a and parts[-1][1] == r.b and all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:]))
        assert len(parts) <= 2 * (r.b - r.a + 1).bit_length()


def test_long_skips_against_every_pair(spark):
    rng = random.Random(8)
    rows, numbers = [], sorted(rng.sample(range(1, 10 ** 9), 60)) + [10 ** 15]
    for i, num in enumerate(numbers):
        to = rng.choice([num + 1, num + 2, *numbers, 10 ** 16, num - 1])
        rows.append((2024, "t", f"v{i:03}", "", f"{num}. Una pregunta? 1 Sí (PASE A P{to})" if i % 3 else f"{num}. Otra?", "", ""))
    want = {(n, m) for n, r in zip(numbers, rows) if "PASE" in r[4] for m in numbers if n < m < int(r[4].split(" P")[-1][:-1])}
    got = skips.prior_conditions(spark.createDataFrame(rows, KIND)).collect()
    assert {(r.previa, r.num) for r in got} == want and len(got) == len(want) > 300


def test_long_answers_stay_when_asked_for(spark):
    docs = spark.createDataFrame([(2024, "t", "v", "", "1. Qué? 1 " + "Una respuesta muy larga de verdad que no cabe en cuarenta" + " (PASE A P9)", "", "")], KIND)
    assert [r.respuesta for r in skips.skip_options(docs).collect()] == [""]
    assert [r.respuesta for r in skips.skip_options(docs, max_answer=None).collect()][0].startswith("Una respuesta muy larga")
