import pytest
from pyspark.sql import functions as F

from comarca.operators import density, layers, quality, sheets
from comarca.spec import IndicatorSpec


@pytest.fixture(scope="module")
def result(spark):
    return spark.createDataFrame([("01", 10.0, 4), ("02", None, 0), ("99", 5.0, 9)],
                                 "geo_code string, valor double, casos bigint")


@pytest.fixture(scope="module")
def geo(spark):
    return spark.createDataFrame([("01", "Uno", "g1"), ("02", None, "g2"), ("03", "T", "g3")],
                                 "geo_code string, geo_nombre string, geometria string")


def test_names(result):
    rows = layers.with_names(result, layers.department_names(result)).collect()
    assert {(r.geo_code, r.geo_nombre) for r in rows} == \
        {("01", "Chuquisaca"), ("02", "La Paz"), ("99", "99")}
    assert layers.with_names(result).columns == ["geo_code", "geo_nombre", "valor", "casos"]


def test_area_layer_keeps_areas_without_data(result, geo):
    rows = {r.geo_code: (r.nombre_geo, r.valor_censo, r.casos_censo)
            for r in layers.area_layer(geo, result).collect()}
    assert rows == {"01": ("Uno", 10.0, 4), "02": ("02", None, 0), "03": ("T", None, None)}
    assert "casos_censo" not in layers.area_layer(geo, result.drop("casos")).columns
    assert layers.area_layer(geo, result, department="3").count() == 1


def test_anti_and_semi_make_the_whole(result, geo):
    without = quality.codes_without_geometry(result, geo).count()
    assert without == 1 and quality.codes_with_geometry(result, geo).count() == 2
    assert tuple(quality.map_coverage(result, geo).first()) == (2, 1)
    assert [r.geo_code for r in quality.geometry_without_data(geo, result).collect()] == ["03"]


def test_fragile_cells_need_a_value(result):
    assert tuple(quality.fragile_summary(result, "mean").first()) == (1, 2)
    assert tuple(quality.fragile_summary(result, "__count__").first()) == (0, 0)
    flags = {r.geo_code: r.fragil for r in quality.with_fragile_flag(result).collect()}
    assert flags == {"01": True, "02": False, "99": False}


def test_density(spark, result):
    areas = spark.createDataFrame([("010101", 4.0), ("010102", 1.0), ("020101", None)],
                                  "geo_code string, superficie_km2 double")
    by_dep = density.surfaces(areas, "departamento")
    got = {r.geo_code: r.valor for r in density.density(result, by_dep, IndicatorSpec()).collect()}
    assert got == {"01": 2.0, "02": None, "99": None}
    whole = spark.createDataFrame([(100.0, 1)], "valor double, casos bigint")
    ref = lambda **kw: density.reference_density(
        whole, density.surfaces(areas), **kw).first().valor
    assert ref() == 20.0 and ref(municipality="10101") == 25.0
    assert ref(department="1") == 20.0 and ref(department="2") is None
    with pytest.raises(ValueError):
        density.density(result, by_dep, IndicatorSpec(measure="mean", variable="x"))


def test_reconcile(spark, result):
    other = spark.createDataFrame([("01", 10.0), ("02", None), ("98", 1.0)],
                                  "geo_code string, valor double")
    rows = {r.geo_code: r.coincide for r in quality.reconcile(result, other).collect()}
    assert rows == {"01": True, "02": True, "98": False, "99": False}
    assert quality.differences(quality.reconcile(result, result)).count() == 0


def test_sheets(spark):
    df = spark.createDataFrame([("a", 1, 2, 3, 0), ("b", 2, 2, 4, 0)],
                               "codigo string, x_h int, x_m int, solo_h int, tot int")
    assert sheets.complete_pairs(df.columns) == ["x"]
    assert sheets.derive_pairs(df).selectExpr("sum(x)").first()[0] == 7
    spec = IndicatorSpec("unidad", "porcentaje", "x_h")
    rows = {r.geo_code: (r.valor, r.casos)
            for r in sheets.sheet_indicator(df, spec, "x_h", "tot").collect()}
    assert rows == {"a": (None, 0), "b": (None, 0)}
    with pytest.raises(ValueError):
        sheets.sheet_indicator(df, spec, "x_h", None)
    with pytest.raises(ValueError):
        sheets.sheet_batch(df, spec, {"x_h": ("x_h", None)})
    total = sheets.sheet_reference(df, IndicatorSpec("unidad", "total", "x_h"), "x_h").first()
    assert tuple(total) == (3.0, 3)


def test_denominator_note(spark):
    sizes = spark.createDataFrame([(7940, 4409)], "n_total bigint, n_valid bigint")
    row = quality.denominator_note(sizes, "pct_category").first()
    assert (row.n_denominador, row.n_otro, row.pct_con_dato, row.cobertura_baja) == \
        (4409, 7940, 55.5, True)
    assert quality.denominator_note(sizes, "pct_total").first().denominador == "registros"


def test_sheet_coverage(spark):
    units = spark.createDataFrame([("1", 10, True), ("1", 30, None), ("2", 0, False)],
                                  "idep string, personas int, ficha boolean")
    rows = {r.geo_code: (r.poblacion, r.con_ficha, r.cobertura_pct)
            for r in quality.sheet_coverage(units, "departamento").collect()}
    assert rows == {"01": (40, 10, 25.0), "02": (0, 0, None)}


def test_levels_that_lose_rows(spark):
    rows = [("1", "1", "1", "a", 2.0), ("01", "1", "1", "b", 3.0), ("1", "1", None, "c", 4.0), (None, "1", "1", "d", 5.0), ("2", "1", "1", None, 6.0)]
    df = spark.createDataFrame(rows, "idep string, iprov string, imun string, codigo string, n double")
    got = {(r.nivel, r.geo_code): (r.partes, r.suma_partes, r.total, r.diferencia)
           for r in quality.levels_reconciled(df, amount=F.col("n")).collect()}
    assert got == {("total", None): (2, 15.0, 20.0, 5.0), ("departamento", "01"): (1, 5.0, 9.0, 4.0), ("departamento", "02"): (1, 6.0, 6.0, 0.0),
                   ("municipio", "010101"): (2, 5.0, 5.0, 0.0), ("municipio", "020101"): (0, 0.0, 6.0, 6.0)}
    assert {r.total for r in quality.levels_reconciled(df).filter("nivel = 'total'").collect()} == {5}


def test_numbers_over_ranges(spark):
    from comarca.operators.numbering import numbered
    df = spark.createDataFrame([(f"{i * 7919 % 5000:05d}",) for i in range(5000)], "v string").repartition(6)
    assert [(r.v, r.n) for r in numbered(df, "v", "n", 1).orderBy("v").collect()] == [(f"{i:05d}", i + 1) for i in range(5000)]
    assert numbered(df.filter("false"), "v", "n").count() == 0
