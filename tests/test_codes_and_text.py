from pyspark.sql import functions as F

from comarca.functions.codes import category_eq, category_order, normalize_code, zero_fill
from comarca.functions.text import (
    first_upper, format_number, shorten, squeeze, universe_text, variable_label,
)


def values(spark, items, fn, kind="string"):
    rows = [(i, v) for i, v in enumerate(items)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_normalize_code(spark):
    given = ["001", "1", " 07\t", "-0", "-003", "000", "A01", "1.0", "", None,
             "0" * 5 + "9" * 30, "--5"]
    assert values(spark, given, normalize_code) == [
        "1", "1", "7", "0", "-3", "0", "A01", "1.0", "", None, "9" * 30, "--5"]


def test_zero_fill(spark):
    assert values(spark, ["5", "-5", "+5", "1234567", "", None],
                  lambda c: zero_fill(c, 6)) == \
        ["000005", "-00005", "+00005", "1234567", "000000", None]


def test_category_equality(spark):
    df = spark.createDataFrame([("001",), ("1",), ("x'y",), ("2",), (None,)], "v string")
    hits = lambda c: [r[0] for r in df.select(category_eq(df, "v", c)).collect()]
    assert hits("1") == [True, True, None, False, None]
    assert hits(1) == hits("01")
    assert hits("x'y") == [False, False, True, False, None]


def test_category_order(spark):
    df = spark.createDataFrame([("b",), ("10",), ("-1",), ("2",), ("a",)], "v string")
    assert [r[0] for r in df.orderBy(*category_order(F.col("v"))).collect()] == \
        ["-1", "2", "10", "a", "b"]


def test_numbers(spark):
    given = [16666665.5, 16666666.0, 0.1, -1234.567, 1e-12, 12.0, 1234.001, None]
    assert values(spark, given, format_number, "double") == [
        "16.666.665,5", "16.666.666", "0,1", "-1.234,57", "0", "12", "1.234", None]
    assert values(spark, [30.46, 1234.0], lambda c: format_number(c, percent=True),
                  "double") == ["30,5%", "1234,0%"]


def test_universe_text(spark):
    given = ["personas_7_mas", "MUJERES_15_49", "todas_personas", "zonas_rurales",
             "personas_x_mas", "", None]
    assert values(spark, given, universe_text) == [
        "personas de 7 años o más", "mujeres de 15 a 49 años", "todas las personas",
        "zonas rurales", "personas x mas", None, None]


def test_small_text_functions(spark):
    assert values(spark, [" a  b\n c "], squeeze) == ["a b c"]
    assert values(spark, ["uno dos tres", "abcdefghij", "corto"],
                  lambda c: shorten(c, 8)) == ["uno dos…", "abcdefgh…", "corto"]
    assert values(spark, ["salud y VIDA"], first_upper) == ["Salud y vida"]
    label = lambda c: variable_label(F.lit("p26"), c, 12)
    assert values(spark, ["26. ¿Edad?:", None, "Tiene una etiqueta larga", "3 cosas. Sí"],
                  label) == ["¿Edad? (p26)", "p26", "Tiene una et… (p26)", "Sí (p26)"]
