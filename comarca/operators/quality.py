"""What has to be said next to a value: coverage, fragile cells, notes, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from comarca.fixed_values import (
    FRAGILE_CASES, LOW_COVERAGE_PCT, NOTE_SKIP_ONLY, NOTE_UNIVERSE, NOTE_WITHIN,
    OBVIOUS_UNIVERSES,
)
from comarca.functions.codes import in_department
from comarca.functions.text import universe_text
from comarca.operators.territory import geo_code, source_columns
from comarca.sources.tables import GeoColumns
from comarca.spec import COUNT


def _codes_of(geometry: DataFrame, department=None) -> DataFrame:
    codes = geometry.select("geo_code").distinct()
    if department is not None:
        codes = codes.filter(in_department(F.col("geo_code"), department))
    return codes


def codes_with_geometry(result: DataFrame, geometry: DataFrame, department=None) -> DataFrame:
    """Result rows that a map can draw."""
    return result.join(_codes_of(geometry, department), "geo_code", "left_semi")


def codes_without_geometry(result: DataFrame, geometry: DataFrame,
                           department=None) -> DataFrame:
    """Result rows whose code has no geometry (an older territorial division)."""
    return result.join(_codes_of(geometry, department), "geo_code", "left_anti")


def geometry_without_data(geometry: DataFrame, result: DataFrame) -> DataFrame:
    """Geometries whose code has no result."""
    return geometry.join(result.select("geo_code").distinct(), "geo_code", "left_anti")


def map_coverage(result: DataFrame, geometry: DataFrame, department=None) -> DataFrame:
    """(mapeados, sin_geometria): distinct codes with and without geometry."""
    asked = result.select("geo_code").distinct()
    known = _codes_of(geometry, department).withColumn("known", F.lit(True))
    joined = asked.join(known, "geo_code", "left")
    return joined.agg(F.count("known").alias("mapeados"),
                      (F.count(F.lit(1)) - F.count("known")).alias("sin_geometria"))


def _is_fragile(result: DataFrame, threshold: int) -> Column:
    if "casos" not in result.columns:
        return F.lit(False)
    return F.coalesce(F.col("valor").isNotNull() & (F.col("casos") < threshold),
                      F.lit(False))


def with_fragile_flag(result: DataFrame, threshold: int = FRAGILE_CASES) -> DataFrame:
    """Flag territories whose value rests on too few cases.  Nothing is suppressed."""
    return result.withColumn("fragil", _is_fragile(result, threshold))


def fragile_summary(result: DataFrame, measure: str | None = None,
                    threshold: int = FRAGILE_CASES) -> DataFrame:
    """(n_fragiles, n_con_valor).  Zeros without a ``casos`` column, and for measures
    whose value is itself the number of cases."""
    if "casos" not in result.columns or measure in (COUNT, "total"):
        return result.agg(F.lit(0).cast("bigint").alias("n_fragiles"),
                          F.lit(0).cast("bigint").alias("n_con_valor"))
    return result.agg(
        F.count_if(_is_fragile(result, threshold)).alias("n_fragiles"),
        F.count_if(F.col("valor").isNotNull() & F.col("casos").isNotNull())
        .alias("n_con_valor"))


def denominator_note(sizes: DataFrame, measure: str) -> DataFrame:
    """Which denominator a percentage has, its size, the other one, and a warning.

    ``sizes`` has n_total and n_valid (``coverage`` or ``indicator_report``).
    """
    share = F.try_divide(F.col("n_valid") * F.lit(100.0), F.col("n_total").cast("double"))
    over_valid = measure == "pct_category"
    used, other = ("n_valid", "n_total") if over_valid else ("n_total", "n_valid")
    return sizes.withColumns({
        "denominador": F.lit("casos_con_dato" if over_valid else "registros"),
        "n_denominador": F.col(used), "n_otro": F.col(other),
        "pct_con_dato": F.round(share, 1),
        "cobertura_baja": F.coalesce(share < LOW_COVERAGE_PCT, F.lit(False))})


def universe_notes(dictionary: DataFrame, phrases: DataFrame) -> DataFrame:
    """(variable, nota): who a question was asked of, when that is not obvious.

    Joins the declared universe (dictionary) with the skips (phrases: variable, frase).
    """
    declared = dictionary.select("variable", universe_text(F.col("universo")).alias("u"))
    declared = declared.filter(~F.col("u").isin(*OBVIOUS_UNIVERSES))
    both = declared.join(phrases.select("variable", "frase"), "variable", "full_outer")
    u, skip = F.col("u"), F.col("frase")
    note = (F.when(u.isNotNull() & skip.isNotNull(),
                   F.concat(F.lit(NOTE_UNIVERSE), u, F.lit(NOTE_WITHIN), skip, F.lit(".")))
            .when(u.isNotNull(), F.concat(F.lit(NOTE_UNIVERSE), u, F.lit(".")))
            .when(skip.isNotNull(), F.concat(F.lit(NOTE_SKIP_ONLY), skip, F.lit("."))))
    return both.select("variable", note.alias("nota")).filter("nota IS NOT NULL")


def sheet_coverage(units: DataFrame, level: str, population: str = "personas",
                   flag: str = "ficha", geo: GeoColumns | None = None) -> DataFrame:
    """(geo_code, poblacion, con_ficha, cobertura_pct): people in units with a sheet."""
    geo = geo or GeoColumns.of(units)
    people = F.sum(population)
    covered = F.coalesce(F.sum(F.when(F.col(flag), F.col(population))), F.lit(0))
    share = F.try_divide(covered * F.lit(100.0), people.cast("double"))
    return units.groupBy(geo_code(level, geo).alias("geo_code")).agg(
        people.cast("bigint").alias("poblacion"), covered.cast("bigint").alias("con_ficha"),
        F.round(share, 2).alias("cobertura_pct"))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("geo_code",),
              value: str = "valor", tolerance: float = 0.0) -> DataFrame:
    """(keys, izquierda, derecha, diferencia, coincide) of two results, every key of both.

    A key only one side has does not agree.
    """
    a = left.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col(value).alias("izquierda"),
                    F.lit(True).alias("in_a"))
    b = right.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col(value).alias("derecha"),
                     F.lit(True).alias("in_b"))
    same = reduce(and_, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys])
    gap = F.col("izquierda") - F.col("derecha")
    close = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & (
        F.col("izquierda").eqNullSafe(F.col("derecha"))
        | F.coalesce(F.abs(gap) <= tolerance, F.lit(False)))
    return a.join(b, same, "full_outer").select(
        *[F.coalesce(F.col(f"a_{k}"), F.col(f"b_{k}")).alias(k) for k in keys],
        "izquierda", "derecha", gap.alias("diferencia"),
        F.coalesce(close, F.lit(False)).alias("coincide"))


def differences(reconciled: DataFrame) -> DataFrame:
    """Only the keys on which the two sources disagree."""
    return reconciled.filter(~F.col("coincide"))


def parts_and_total(report: DataFrame) -> DataFrame:
    """(suma_partes, total, coincide) of an ``indicator_report`` of a count or a sum."""
    parts = F.sum(F.when(~F.col("es_total"), F.col("valor")))
    total = F.max(F.when(F.col("es_total"), F.col("valor")))
    return (report.agg(parts.alias("suma_partes"), total.alias("total"))
            .withColumn("coincide", F.coalesce(
                F.abs(F.col("suma_partes") - F.col("total"))
                <= F.abs(F.col("total")) * 1e-9, F.lit(False))))


def levels_reconciled(df: DataFrame, geo: GeoColumns | None = None, amount: Column | None = None) -> DataFrame:
    """Each territory's total against the sum of the parts it is divided in.

    (nivel, geo_code, partes, suma_partes, total, diferencia), from the whole table (nivel
    ``total``) down to what holds the smallest level there is; ``amount`` is added up, rows
    if it is None.  A difference is what has a code at a level and none at the next.  One
    pass: rows are added up on the territory columns, every level from that table.
    """
    geo = geo or GeoColumns.of(df)
    levels, codes = ["total"], [F.lit("")]
    for level in ("departamento", "municipio", "unidad"):
        try:
            codes.append(geo_code(level, geo))
            levels.append(level)
        except ValueError:
            continue
    places = list(dict.fromkeys(c for level in levels[1:] for c in source_columns(level, geo)))
    added = F.count(F.lit(1)) if amount is None else F.sum(amount)
    raw = df.groupBy(*[F.col(f"`{c}`") for c in places]).agg(added.alias("_n"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), codes[i].alias("geo_code"), codes[i + 1].alias("part"))
                      for i in range(len(levels) - 1)])
    by_part = (raw.select("_n", F.inline(cells)).filter("geo_code IS NOT NULL")
               .groupBy("i", "geo_code", "part").agg(F.sum("_n").alias("_n")))
    inside = F.when(F.col("part").isNotNull(), F.col("_n"))
    total, parts = F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(inside), F.lit(0))
    return (by_part.groupBy("i", "geo_code").agg(F.count("part").alias("partes"), parts.alias("suma_partes"), total.alias("total"))
            .select(F.get(F.array(*map(F.lit, levels)), F.col("i")).alias("nivel"),
                    F.when(F.col("i") > 0, F.col("geo_code")).alias("geo_code"), "partes", "suma_partes", "total",
                    (F.col("total") - F.col("suma_partes")).alias("diferencia")))
