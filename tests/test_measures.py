import pytest
from pyspark.sql import functions as F

from comarca.operators import measures, quality, territory, universe
from comarca.operators.skips import explain_missing
from comarca.sources.tables import GeoColumns
from comarca.spec import IndicatorSpec

ROWS = [  # idep, iprov, imun, sexo, edad, agro
    ("1", "1", "1", "01", "10", 1), ("01", "1", "01", "2", "20", None),
    ("1", "1", "2", "2", "x", 2), ("2", "1", "1", "1", None, None),
    ("2", "1", "1", "1", "7", None), (None, "1", "1", "2", "4", 9),
]
KIND = "idep string, iprov string, imun string, sexo string, edad string, agro int"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, KIND)


def run(df, level="departamento", **kw):
    return {r.geo_code: (r.valor, r.casos)
            for r in measures.indicator(df, IndicatorSpec(level, **kw)).collect()}


def test_spellings_of_a_code_are_one_territory(people):
    assert run(people) == {"01": (3.0, 3), "02": (2.0, 2), None: (1.0, 1)}
    assert run(people, "municipio") == {"010101": (2.0, 2), "010102": (1.0, 1),
                                        "020101": (2.0, 2), None: (1.0, 1)}


def test_count_of_category_leaves_out_territories_without_it(people):
    assert run(people, variable="sexo", category="1") == {"01": (1.0, 1), "02": (2.0, 2)}
    whole = measures.reference_value(people, IndicatorSpec(variable="sexo", category="7"))
    assert tuple(whole.collect()[0]) == (0.0, 0)


def test_uncastable_text_counts_as_a_case_but_not_in_the_mean(people):
    assert run(people, measure="mean", variable="edad") == \
        {"01": (15.0, 3), "02": (7.0, 1), None: (4.0, 1)}
    assert run(people, measure="sum", variable="edad")["01"] == (30.0, 3)
    assert run(people, measure="median", variable="edad")["01"] == (15.0, 3)


def test_std_of_one_value_is_null(people):
    got = run(people, measure="std", variable="edad")
    assert got["02"] == (None, 1) and got["01"] == (7.0711, 3)


def test_merged_deviation_is_stable_far_from_zero(spark):
    rows = [(str(i % 2), f"{'0' * (i % 3)}5", 1e9 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "p string, idep string, v double")
    got = run(df, measure="std", variable="v")
    assert set(got) == {"05"} and got["05"][0] == pytest.approx(
        df.agg(F.stddev_samp("v")).first()[0], abs=1e-4)


def test_mode_tie_goes_to_the_smallest(people):
    assert run(people, measure="mode", variable="sexo")["02"] == ("1", 2)
    assert run(people, measure="mode", variable="agro") == {"01": (1, 2), None: (9, 1)}


def test_two_denominators(people):
    valid = run(people, measure="pct_category", variable="agro", category=1)
    every = run(people, measure="pct_total", variable="agro", category=1)
    assert valid == {"01": (50.0, 2), "02": (None, 0), None: (0.0, 1)}
    assert every == {"01": (33.33, 3), "02": (0.0, 2), None: (0.0, 1)}


def test_reference_of_no_rows(people):
    none = people.filter("idep = 'zz'")
    for spec, valor, casos in (
            (IndicatorSpec(), 0.0, 0), (IndicatorSpec(measure="mean", variable="edad"), None, 0),
            (IndicatorSpec(measure="median", variable="edad"), None, 0),
            (IndicatorSpec(measure="mode", variable="sexo"), None, 0),
            (IndicatorSpec(measure="pct_total", variable="sexo", category=1), None, 0)):
        assert tuple(measures.reference_value(none, spec).collect()[0]) == (valor, casos)


@pytest.mark.parametrize("spec", [
    IndicatorSpec(), IndicatorSpec(measure="mean", variable="edad"),
    IndicatorSpec(measure="sum", variable="edad"), IndicatorSpec(measure="std", variable="edad"),
    IndicatorSpec(measure="median", variable="edad"),
    IndicatorSpec(measure="mode", variable="sexo"),
    IndicatorSpec(variable="sexo", category="2"),
    IndicatorSpec(measure="pct_category", variable="agro", category="2"),
    IndicatorSpec(measure="pct_total", variable="agro", category="2")])
def test_report_agrees_with_separate_queries(people, spec):
    report = measures.indicator_report(people, spec).collect()
    per = {r.geo_code: (r.valor, r.casos) for r in report if not r.es_total}
    assert per == {r.geo_code: (r.valor, r.casos)
                   for r in measures.indicator(people, spec).collect()}
    total = [r for r in report if r.es_total]
    whole = measures.reference_value(people, spec).collect()[0]
    assert len(total) == 1 and (total[0].valor, total[0].casos) == tuple(whole)


def test_report_counts_valid_and_all(people):
    spec = IndicatorSpec(measure="pct_category", variable="agro", category="1")
    total = [r for r in measures.indicator_report(people, spec).collect() if r.es_total][0]
    assert (total.n_total, total.n_valid) == (6, 3)


def test_share_of_all_is_never_above_share_of_valid(people):
    a = run(people, measure="pct_category", variable="agro", category=2)
    b = run(people, measure="pct_total", variable="agro", category=2)
    assert all(b[k][0] <= a[k][0] for k in a if a[k][0] is not None)


def test_free_expression_and_missing_cases(people):
    df = measures.indicator(people, IndicatorSpec(expression="max(agro)"))
    assert df.columns == ["geo_code", "valor"]
    assert quality.fragile_summary(df).collect()[0] == (0, 0)


def test_batch_equals_one_by_one(people):
    specs = {"a": IndicatorSpec(measure="mean", variable="edad"),
             "b": IndicatorSpec(measure="median", variable="edad"),
             "c": IndicatorSpec(measure="std", variable="edad"),
             "d": IndicatorSpec(variable="sexo", category="1")}
    got = measures.indicator_batch(people, specs).collect()
    for name, spec in specs.items():
        assert {r.geo_code: (r.valor, r.casos) for r in got if r.indicador == name} == \
            {r.geo_code: (r.valor, r.casos)
             for r in measures.indicator(people, spec).collect()}
    with pytest.raises(ValueError):
        measures.indicator_batch(people, {"a": IndicatorSpec(year=2012, table="personas"), "b": IndicatorSpec(year=2024, table="personas")})
    with pytest.raises(ValueError):
        measures.indicator_batch(people, {"a": IndicatorSpec(measure="total", variable="agro")})


def test_batch_over_territories_and_levels(people):
    kinds = [dict(), dict(variable="sexo", category="1"), dict(measure="mean", variable="edad"), dict(measure="std", variable="edad"),
             dict(measure="sum", variable="agro"), dict(measure="pct_total", variable="agro", category=1),
             dict(measure="median", variable="edad"), dict(measure="median", variable="agro"), dict(measure="mode", variable="sexo"),
             dict(expression="count(DISTINCT sexo) + 0D", cases_expression="count(*)")]
    scopes = [dict(level="departamento"), dict(level="municipio"), dict(level="municipio", department="1"),
              dict(level="departamento", municipality="10102"), dict(level="municipio", municipality="020101"), dict(level="municipio", department="9")]
    specs = {f"{i}-{j}": IndicatorSpec(**scope, **kind) for i, scope in enumerate(scopes) for j, kind in enumerate(kinds)}
    got = measures.indicator_batch(people, specs).collect()
    for name, spec in specs.items():
        value = (lambda r: r.categoria) if spec.measure == "mode" else (lambda r: r.valor)
        want = {r.geo_code: (r.valor, r.casos) for r in measures.indicator(people, spec).collect()}
        assert {r.geo_code: (value(r), r.casos) for r in got if r.indicador == name} == want, name


def test_a_batch_of_filtered_specs_reads_only_their_territories(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    geo = GeoColumns(department="l_linenumber")
    specs = {str(d): IndicatorSpec(measure=m, variable="l_quantity", department=d) for d in (1, 2) for m in ("mean", "std")}
    text = measures.indicator_batch(line, specs, geo)._jdf.queryExecution().executedPlan().toString()
    assert "Or(EqualTo(l_linenumber,1),EqualTo(l_linenumber,2))" in text or "In(l_linenumber" in text


@pytest.mark.parametrize("accuracy", [0.2, 0.01, 0.0005])
def test_sketches_merge_upwards_within_their_accuracy(spark, accuracy):
    import numpy as np
    rng = np.random.default_rng(5)
    rows = [(int(d), int(p), 1, float(v)) for d in range(3) for p in range(4) for v in rng.lognormal(d, 2, 150 + 40 * p)]
    rows += [(7, 1, 1, -5.0), (7, 1, 1, -3.0), (7, 2, 1, 0.0), (8, 1, 1, None)]
    df = spark.createDataFrame(rows, "idep int, iprov int, imun int, v double")
    probs = [0.0, 0.1, 0.5, 0.93, 1.0]
    got = measures.approximate_quantiles(df, IndicatorSpec("municipio", "median", "v"), probs, accuracy).collect()
    seen = set()
    for r in got:
        own = [v for d, p, m, v in rows if v is not None and (
            r.nivel == "total" or r.geo_code == (f"{d:02d}" if r.nivel == "departamento" else f"{d:02d}{p:02d}{m:02d}"))]
        assert r.casos == len(own)
        near = np.quantile(own, [r.prob], method="lower")[0], np.quantile(own, [r.prob], method="higher")[0]
        assert abs(r.valor - np.quantile(own, r.prob)) <= accuracy * max(map(abs, near)) * (1 + 1e-9)
        seen.add((r.nivel, r.geo_code))
    assert len(got) == len(seen) * len(probs) and len(seen) == 14 + 4 + 1
    with pytest.raises(ValueError):
        measures.approximate_quantiles(df, IndicatorSpec("municipio", "median", "v"), probs, 0)


def test_filters(people):
    pick = lambda **kw: territory.filter_territory(people, **kw).count()
    assert pick(department="1") == 3 and pick(department="01") == 3
    assert pick(department="2", municipality="10102") == 1    # municipality replaces it
    with pytest.raises(ValueError):
        territory.filter_territory(people.drop("iprov"), municipality="010101")
    with pytest.raises(ValueError):
        territory.filter_territory(people, department="todos")
    for missing in (dict(department="1"), dict(area="rural")):
        with pytest.raises(ValueError):
            territory.filter_territory(people.select("sexo"), **missing)
        assert territory.filter_territory(people.select("sexo"), ignore_missing=True, **missing).count() == 6


def test_missing_levels_are_refused(people):
    for level, drop in (("unidad", []), ("municipio", ["imun"]), ("departamento", ["idep"])):
        with pytest.raises(ValueError):
            measures.indicator(people.drop(*drop), IndicatorSpec(level))


def test_over_long_part_stays_whole(spark):
    df = spark.createDataFrame([("123",), ("-5",), ("0123",), ("005",), ("0",)], "idep string")
    assert {k: n for k, (_, n) in run(df).items()} == {"-5": 1, "123": 2, "05": 1, "00": 1}


def test_long_parts_stay_apart(spark):
    from comarca.functions.codes import department_of, in_department
    rows = [("1", "12", "345"), ("1", "123", "45"), ("123", "4", "5"), ("12", "34", "5"), ("01", "012", "0345"), (None, "1", "200")]
    df = spark.createDataFrame(rows, "idep string, iprov string, imun string")
    assert run(df, "municipio") == {"01-12-345": (2.0, 2), "01-123-45": (1.0, 1), "123-04-05": (1.0, 1), "123405": (1.0, 1), None: (1.0, 1)}
    codes = spark.createDataFrame([(c,) for c in ("01-12-345", "123-04-05", "123405", "12", "123", "010101")], "geo_code string")
    code = F.col("geo_code")
    assert [r[0] for r in codes.select(department_of(code)).collect()] == ["01", "123", "12", "12", "123", "01"]
    assert [r[0] for r in codes.filter(in_department(code, "12")).collect()] == ["123405", "12"]
    assert [r[0] for r in codes.filter(in_department(code, 123)).collect()] == ["123-04-05", "123"]


def test_dwelling_universe(spark):
    df = spark.createDataFrame([("1",), ("015",), ("16",), (None,), ("14",), ("x",)],
                               "v01_tipoviv string")
    assert universe.apply_universe(df, 2024, "viviendas").count() == 2
    assert universe.apply_universe(df, 1976, "viviendas").count() == 6
    assert universe.apply_universe(df, 2024, "personas").count() == 6
    assert {y for y in universe.DWELLING_TYPES} == {1976, 1992, 2001, 2012, 2024}
    kinds = [r[0] for r in df.select(universe.dwelling_kind(df, 2024)).collect()]
    assert kinds == ["particular", "no_vivienda", "no_vivienda", None, "colectiva", None]
    with pytest.raises(ValueError):
        universe.apply_universe(df, 2012, "viviendas")


def test_missing_answers_are_fully_explained(spark):
    rows = [(3, 1, 2, None), (30, 1, 2, None), (30, 2, 1, None), (30, 2, 2, 1),
            (30, 2, 2, None), (None, 1, 1, None)]
    df = spark.createDataFrame(rows, "edad int, p43 int, p44 int, p45 int")
    got = explain_missing(df, "p45", F.col("edad") >= 7,
                          (F.col("p43") == 1) | (F.col("p44") == 1)).collect()[0]
    assert tuple(got) == (6, 5, 1, 2, 2)


def test_hot_unit_median_and_mode(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
        .alias("codigo"), (F.col("id") * 7 % 1000).cast("double").alias("v"))
    geo = GeoColumns(unit="codigo")
    got = {r.geo_code: r.valor for r in measures.indicator(
        df, IndicatorSpec("unidad", "median", "v"), geo).collect()}
    assert got["hot"] == df.filter("codigo = 'hot'").agg(F.median("v")).first()[0]
    assert len(got) == 2001


def test_sheet_measures_are_not_microdata_measures(people):
    for run_it in (measures.indicator, measures.reference_value, measures.indicator_report):
        with pytest.raises(ValueError):
            run_it(people, IndicatorSpec(measure="total", variable="agro"))


def test_variable_that_is_also_the_territory(people):
    got = run(people, measure="mode", variable="idep")
    assert got == {"01": ("1", 3), "02": ("2", 2)}
    assert run(people, measure="median", variable="idep")["01"] == (1.0, 3)
    assert run(people, measure="mean", variable="idep")["02"] == (2.0, 2)


def test_batch_and_report_take_modes_and_expressions(people):
    specs = {"n": IndicatorSpec(), "moda": IndicatorSpec(measure="mode", variable="sexo"),
             "libre": IndicatorSpec(expression="count(*) / 2.0", cases_expression="count(*)")}
    rows = {(r.indicador, r.geo_code): r for r in measures.indicator_batch(people, specs).collect()}
    mode = {r.geo_code: (r.valor, r.casos) for r in measures.indicator(people, specs["moda"]).collect()}
    assert {g: (r.categoria, r.casos) for (i, g), r in rows.items() if i == "moda"} == {
        g: (str(v), n) for g, (v, n) in mode.items()}
    for (i, g), r in rows.items():
        if i == "libre":
            assert r.valor == rows["n", g].valor / 2 and r.casos == rows["n", g].casos
    report = measures.indicator_report(people, specs["libre"]).collect()
    assert sum(r.es_total for r in report) == 1
    assert {r.geo_code: r.valor for r in report if not r.es_total} == {g: r.valor for (i, g), r in rows.items() if i == "libre"}


HOLISTIC = ["median(edad)", "round(median(edad + 1) / avg(edad) + count(DISTINCT sexo), 3)", "count(DISTINCT sexo) - count(sexo)",
            "percentile(edad, 0.25) FILTER (WHERE agro > 1) + 0D", "mode(sexo)", "CASE WHEN count(*) > 2 THEN median(edad) END",
            "count(DISTINCT agro, sexo) + sum(agro)", "percentile(edad, array(0.1, 0.9))[1]"]


@pytest.mark.parametrize("text", HOLISTIC)
def test_holistic_parts_of_expressions(spark, text):
    rows = [(str(i % 3), "1" if i % 4 else "2", None if i % 5 == 0 else float(i * 7 % 31), i % 3 if i % 6 else None) for i in range(200)]
    rows += [("7", None, None, None), (None, "3", 4.0, 5)]
    df = spark.createDataFrame(rows, "idep string, sexo string, edad double, agro int")
    own = df.withColumn("geo_code", F.lpad("idep", 2, "0"))
    near = lambda rows: {r.geo_code: pytest.approx(r.valor, rel=1e-12) if isinstance(r.valor, float) else r.valor for r in rows}
    want = own.groupBy("geo_code").agg(F.expr(text).alias("valor"), F.expr("count(DISTINCT sexo)").alias("casos")).collect()
    spec = IndicatorSpec(expression=text, cases_expression="count(DISTINCT sexo)")
    got = measures.indicator(df, spec).collect()
    assert {r.geo_code: r.valor for r in got} == near(want) and {r.geo_code: r.casos for r in got} == {r.geo_code: r.casos for r in want}
    whole = own.agg(F.expr(text).alias("valor")).first().valor
    whole = pytest.approx(whole, rel=1e-12) if isinstance(whole, float) else whole
    assert measures.reference_value(df, spec).first().valor == whole
    report = measures.indicator_report(df, spec).collect()
    assert [r.valor for r in report if r.es_total] == [whole] and {r.geo_code: r.valor for r in report if not r.es_total} == near(want)
    empty = measures.reference_value(df.filter("false"), spec).collect()
    assert [r.valor for r in empty] == [r.valor for r in df.filter("false").agg(F.expr(text).alias("valor")).collect()]


def test_a_holistic_part_holds_no_group(spark):
    df = spark.range(50_000).select(F.lit("1").alias("idep"), F.col("id").cast("double").alias("v"))
    found = measures.indicator(df, IndicatorSpec(expression="median(v) + max(v)"))
    assert "percentile" not in found._jdf.queryExecution().executedPlan().toString().lower()
    assert found.first().valor == 24999.5 + 49999
