"""Indicators over pre-aggregated sheets: sums and ratios of sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from comarca.operators.measures import indicator_expr, reference_expr
from comarca.operators.territory import geo_code, scope
from comarca.sources.tables import GeoColumns
from comarca.spec import IndicatorSpec


def ratio_of_sums(numerator: str, denominator: str) -> Column:
    """100 × Σ numerator / Σ denominator, NULL over an empty denominator.

    The right way to aggregate a share: never the mean of the shares.
    """
    top, bottom = F.sum(F.expr(numerator)), F.sum(F.expr(denominator))
    return F.round(F.try_divide(top.cast("double") * F.lit(100.0),
                                bottom.cast("double")), 2)


def sheet_value(expr: str, denominator: str | None, measure: str) -> Column:
    """The value of a sheet indicator as an aggregate."""
    if measure == "porcentaje":
        if not denominator:
            raise ValueError(f"{expr} is the total of its block: it has no denominator")
        return ratio_of_sums(expr, denominator)
    if measure != "total":
        raise ValueError(f"a sheet indicator is a total or a porcentaje, not {measure}")
    return F.sum(F.expr(expr)).cast("double")


def sheet_cases(expr: str, denominator: str | None, measure: str) -> Column:
    """How many cases are behind it: the denominator of a share, else the count itself."""
    base = denominator if measure == "porcentaje" and denominator else expr
    return F.sum(F.expr(base)).cast("bigint")


def with_sheet_expressions(spec: IndicatorSpec, expr: str,
                           denominator: str | None) -> IndicatorSpec:
    """A sheet spec as the two SQL aggregates it stands for."""
    if spec.measure == "porcentaje":
        if not denominator:
            raise ValueError(f"{spec.variable} is the total of its block: "
                             "it has no denominator")
        value = f"round(100D * sum({expr}) / nullif(sum({denominator}), 0), 2)"
        cases = f"sum({denominator})"
    else:
        value, cases = f"CAST(sum({expr}) AS DOUBLE)", f"sum({expr})"
    return replace(spec, expression=value, cases_expression=f"CAST({cases} AS BIGINT)")


def sheet_indicator(df: DataFrame, spec: IndicatorSpec, expr: str,
                    denominator: str | None = None,
                    geo: GeoColumns | None = None) -> DataFrame:
    """(geo_code, valor, casos) of one catalogue indicator."""
    return indicator_expr(df, with_sheet_expressions(spec, expr, denominator), geo)


def sheet_reference(df: DataFrame, spec: IndicatorSpec, expr: str,
                    denominator: str | None = None,
                    geo: GeoColumns | None = None) -> DataFrame:
    """(valor, casos) of one catalogue indicator over the whole territory."""
    return reference_expr(df, with_sheet_expressions(spec, expr, denominator), geo)


def sheet_batch(df: DataFrame, spec: IndicatorSpec,
                indicators: Mapping[str, tuple[str, str | None]],
                geo: GeoColumns | None = None) -> DataFrame:
    """Many catalogue indicators in one pass: (variable, geo_code, valor, casos).

    ``indicators``: variable → (expression, denominator).  In a percentage batch the
    ones without denominator are left out.
    """
    geo = geo or GeoColumns.of(df)
    share = spec.measure == "porcentaje"
    chosen = {v: (e, d) for v, (e, d) in indicators.items() if d or not share}
    if not chosen:
        raise ValueError("no indicator of the batch has a denominator")
    aggs = []
    for i, (e, d) in enumerate(chosen.values()):
        aggs += [sheet_value(e, d, spec.measure).alias(f"v{i}"),
                 sheet_cases(e, d, spec.measure).alias(f"c{i}")]
    wide = (scope(df, spec, geo)
            .groupBy(geo_code(spec.level, geo).alias("geo_code")).agg(*aggs))
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"v{i}").alias("valor"),
                               F.col(f"c{i}").alias("casos"))
                      for i, v in enumerate(chosen)])
    return (wide.select("geo_code", F.inline(cells))
            .select("variable", "geo_code", "valor", "casos"))


def complete_pairs(columns: Sequence[str], suffixes: tuple[str, str] = ("_h", "_m")
                   ) -> list[str]:
    """Bases that have both columns of the pair."""
    first, second = suffixes
    return sorted(c[:-len(first)] for c in columns
                  if c.endswith(first) and c[:-len(first)] + second in columns)


def derive_pairs(df: DataFrame, suffixes: tuple[str, str] = ("_h", "_m")) -> DataFrame:
    """Add the both-sex column of every complete pair; incomplete pairs are skipped."""
    first, second = suffixes
    return df.withColumns({base: F.col(base + first) + F.col(base + second)
                           for base in complete_pairs(df.columns, suffixes)})
