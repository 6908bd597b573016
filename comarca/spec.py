"""What an indicator is: the query description every operator understands."""

from __future__ import annotations

import dataclasses
import hashlib
import re
from dataclasses import dataclass

from comarca.fixed_values import (
    AREAS, DENSITY_UNIT, LEGAL_MEASURES, LEVEL_WORDS, SEMANTIC_TYPES, SHEET_TABLES,
    TITLE_BY_UNIT, TITLES,
)

LEVELS = ("departamento", "municipio", "unidad")
COUNT = "__count__"
PERCENTAGES = ("pct_category", "pct_total")
MEASURES = (COUNT, "mean", "sum", "median", "std", "mode") + PERCENTAGES
SHEET_MEASURES = ("total", "porcentaje")


@dataclass(frozen=True)
class IndicatorSpec:
    """One indicator: a measure of a variable, per territory of a level.

    ``department``, ``municipality`` and ``area`` restrict the rows; ``year`` and
    ``table`` select the table's own universe and name the output.
    ``expression`` (a Spark SQL aggregate) replaces variable and measure.
    """

    level: str = "departamento"
    measure: str = COUNT
    variable: str | None = None
    category: str | int | None = None
    department: str | int | None = None
    municipality: str | int | None = None
    area: str | None = None
    year: int | None = None
    table: str | None = None
    expression: str | None = None
    cases_expression: str | None = None

    def __post_init__(self):
        if self.level not in LEVELS:
            raise ValueError(f"unknown level {self.level!r}; use one of {LEVELS}")
        if self.area is not None and str(self.area).lower() not in AREAS:
            raise ValueError(f"unknown area {self.area!r}; use one of {tuple(AREAS)}")
        for name in ("department", "municipality"):
            code = getattr(self, name)
            if code is not None and not re.fullmatch(r"\d+", str(code).strip()):
                raise ValueError(f"{name} must be a numeric code, got {code!r}")
        if self.municipality is not None and len(str(self.municipality).strip()) > 6:
            raise ValueError("a municipality code has at most 6 digits")
        if self.expression is not None:
            return
        if self.measure not in MEASURES + SHEET_MEASURES:
            raise ValueError(f"unknown measure {self.measure!r}")
        if self.measure in PERCENTAGES and self.category is None:
            raise ValueError(f"{self.measure} needs a category")
        needs_variable = self.measure != COUNT or self.category is not None
        if needs_variable and not self.variable:
            raise ValueError(f"{self.measure} needs a variable")

    @property
    def is_percentage(self) -> bool:
        return self.expression is None and self.measure in PERCENTAGES + ("porcentaje",)

    @property
    def is_categorical_map(self) -> bool:
        return self.expression is None and self.measure == "mode"

    def can_be_density(self) -> bool:
        """Densities make sense for magnitudes, where a surface is declared."""
        return (self.expression is None and self.measure in (COUNT, "sum")
                and self.level in ("departamento", "municipio"))


def semantic_type(variable: str | None, table: str | None, declared: str | None) -> str:
    """count, sheet, categorical, numeric or unknown — decides the legal measures."""
    if not variable or variable == COUNT:
        return "count"
    if table in SHEET_TABLES:
        return "sheet"
    return SEMANTIC_TYPES.get((declared or "").strip().lower(), "unknown")


def allowed_measures(kind: str, has_categories: bool = True,
                     has_denominator: bool = False) -> tuple[str, ...]:
    """Measures that may be asked of a variable of this semantic type."""
    if kind == "sheet":
        return SHEET_MEASURES if has_denominator else SHEET_MEASURES[:1]
    legal = LEGAL_MEASURES.get(kind, ())
    if not has_categories:
        legal = tuple(m for m in legal if m not in PERCENTAGES)
    return legal


def check_measure(spec: IndicatorSpec, declared: str | None,
                  has_categories: bool = True, has_denominator: bool = False) -> None:
    """Raise when the measure is not legal for the variable's declared type."""
    if spec.expression is not None:
        return
    if spec.measure == COUNT:
        return
    kind = semantic_type(spec.variable, spec.table, declared)
    legal = allowed_measures(kind, has_categories, has_denominator)
    if spec.measure not in legal:
        raise ValueError(f"{spec.measure} is not defined for a {kind} variable; "
                         f"use one of {legal}")


def output_name(spec: IndicatorSpec, density: bool = False) -> str:
    """A readable start, then a digest of every field: different results, different names."""
    fields = {**{f.name: getattr(spec, f.name) for f in dataclasses.fields(spec)}, "density": density}
    digest = hashlib.sha256(repr(sorted(fields.items())).encode()).hexdigest()[:20]
    readable = [spec.table, spec.year, spec.level, spec.variable, "expression" if spec.expression else spec.measure]
    return "-".join([*(str(x)[:40] for x in readable if x is not None), digest])


def safe_path_name(name: str) -> str:
    """The name with everything but letters, digits, ``_ . -`` replaced."""
    return re.sub(r"[^A-Za-z0-9_.-]", "_", name) or "capa"


def indicator_title(spec: IndicatorSpec, label: str | None = None,
                    category_label: str | None = None, density: bool = False) -> str:
    """The sentence that says what a result shows."""
    template = TITLES["expression" if spec.expression is not None else spec.measure]
    unit = LEVEL_WORDS[spec.level]
    return TITLE_BY_UNIT.format(
        title=template.format(label=label or spec.variable, category=category_label or spec.category),
        unit=DENSITY_UNIT.format(unit=unit) if density else unit)
