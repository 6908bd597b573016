"""Which rows of a table are cases: exclusion by code, and its audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from comarca.fixed_values import DWELLING_TABLE, DWELLING_TYPES
from comarca.functions.codes import int_code
from comarca.sources.tables import pick_column


def dwelling_universe(year: int | None, table: str | None) -> tuple[str, tuple[int, ...]] | None:
    """(type column, codes that are not dwellings), or None when all rows count."""
    if table != DWELLING_TABLE or year not in DWELLING_TYPES:
        return None
    column, excluded = DWELLING_TYPES[year][:2]
    return (column, excluded) if excluded else None


def not_in_codes(df: DataFrame, column: str, codes: Sequence[int]) -> Column:
    """True outside the codes; NULL (so: dropped) where the code is missing or no integer."""
    return ~int_code(df, column).isin(list(codes))


def apply_universe(df: DataFrame, year: int | None, table: str | None) -> DataFrame:
    """Rows in the table's universe.  Only dwellings have rows outside it."""
    rule = dwelling_universe(year, table)
    if rule is None:
        return df
    column = pick_column(df.columns, [rule[0]])
    if column is None:
        raise ValueError(f"the universe of {table} {year} needs column {rule[0]}")
    return df.filter(not_in_codes(df, column, rule[1]))


def classify_by_codes(df: DataFrame, column: str,
                      groups: Mapping[str, Sequence[int]]) -> Column:
    """Name of the group whose codes hold the row's code; NULL in none."""
    code = int_code(df, column)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, codes in groups.items():
        out = out.when(code.isin(list(codes)), F.lit(name))
    return out


def dwelling_kind(df: DataFrame, year: int) -> Column:
    """particular, colectiva or no_vivienda, by the census's own codes."""
    column, excluded, private, collective = DWELLING_TYPES[year]
    groups = {"particular": private, "colectiva": collective, "no_vivienda": excluded}
    found = pick_column(df.columns, [column])
    if found is None:
        raise ValueError(f"the dwelling type of {year} is column {column}")
    return classify_by_codes(df, found, {k: v for k, v in groups.items() if v})


def universe_impact(df: DataFrame, universe: Column,
                    by: Sequence[str] = ()) -> DataFrame:
    """Raw rows, rows in the universe and rows left out, in one pass."""
    raw, inside = F.count(F.lit(1)), F.count_if(universe)
    return df.groupBy(*by).agg(raw.alias("n_crudo"), inside.alias("n_universo"),
                               (raw - inside).alias("n_fuera"))
