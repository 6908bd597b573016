import dataclasses

import pytest

from comarca.spec import (
    IndicatorSpec, allowed_measures, check_measure, indicator_title, output_name,
    safe_path_name, semantic_type,
)


@pytest.mark.parametrize("bad", [
    dict(level="canton"), dict(measure="max", variable="x"), dict(measure="mean"),
    dict(measure="pct_total", variable="x"), dict(area="costera"),
    dict(department="La Paz"), dict(municipality="0201050"), dict(category="1"),
])
def test_invalid_specs_are_refused(bad):
    with pytest.raises(ValueError):
        IndicatorSpec(**bad)


def test_measures_by_type():
    assert semantic_type(None, None, None) == "count"
    assert semantic_type("x", "fichas", "numerica") == "sheet"
    assert semantic_type("x", "personas", "Texto") == "categorical"
    assert semantic_type("x", "personas", None) == "unknown"
    assert allowed_measures("categorical") == ("pct_category", "pct_total", "mode")
    assert allowed_measures("categorical", has_categories=False) == ("mode",)
    assert allowed_measures("numeric") == ("mean", "median", "sum", "std")
    assert allowed_measures("sheet") == ("total",)
    assert allowed_measures("sheet", has_denominator=True) == ("total", "porcentaje")
    with pytest.raises(ValueError):
        check_measure(IndicatorSpec(measure="mean", variable="sexo"), "categorica")
    check_measure(IndicatorSpec(measure="mean", variable="edad"), "numerica")


def test_names_and_titles():
    spec = IndicatorSpec("municipio", "pct_total", "p52_pais_mov_cod", "1", department="09",
                         year=2024, table="personas")
    assert output_name(spec).startswith("personas-2024-municipio-p52_pais_mov_cod-pct_total-")
    free = IndicatorSpec("unidad", expression="avg(x)", municipality="020105", area="rural")
    one, names = IndicatorSpec("municipio", "pct_category", "v" * 60 + "1", "1"), set()
    others = [dict(variable="v" * 60 + "2"), dict(category="2"), dict(category=1), dict(department="1"), dict(area="rural"),
              dict(year=2012), dict(table="personas"), dict(level="unidad"), dict(measure="pct_total")]
    every = [one, *[dataclasses.replace(one, **o) for o in others], free, dataclasses.replace(free, expression="avg(y)")]
    names = {output_name(s) for s in every} | {output_name(IndicatorSpec(), density=True), output_name(IndicatorSpec())}
    assert len(names) == len(every) + 2 and output_name(one) == output_name(dataclasses.replace(one))
    assert safe_path_name("a b/ñ") == "a_b__"
    assert indicator_title(spec, "País", "1 — Bolivia") == \
        "% con «1 — Bolivia» en País (sobre todos los registros) — por municipio"
    assert indicator_title(IndicatorSpec(), density=True) == \
        "Conteo de registros — por km² (departamento)"
    assert not IndicatorSpec(measure="mean", variable="x").can_be_density()
