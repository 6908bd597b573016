"""Free aggregate expressions whose parts Spark would hold whole in one task.

``median``, ``percentile``, ``mode`` and ``count(DISTINCT …)`` keep a group's values
together.  Spark's own parser says where an expression has them; each is computed the way
the measures are (histograms, counts per value), the other aggregates as they are written,
and the rest of the expression is evaluated on the results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from comarca.operators import quantiles


class Aggregate(NamedTuple):
    """One aggregate of an expression: as text, or (kind, value) where it is holistic."""

    text: str
    kind: str | None = None
    value: str | None = None
    share: float = 0.5


def _children(node) -> list:
    found = node.children()
    return [found.apply(i) for i in range(found.size())]


def _is_aggregate(spark: SparkSession, node) -> bool:
    name = node.nameParts().apply(node.nameParts().size() - 1)
    known = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(
        spark.sparkContext._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name.lower()))
    return known.isEmpty() or known.get().getGroup() == "agg_funcs"    # a function of the session's own counts as one


def _aggregate(node) -> Aggregate:
    name = node.nameParts().apply(node.nameParts().size() - 1).lower()
    args = [node.arguments().apply(i).sql() for i in range(node.arguments().size())]
    where = node.filter().get().sql() if node.filter().isDefined() else None
    text = f"{name}({'DISTINCT ' if node.isDistinct() else ''}{', '.join(args)})" + (f" FILTER (WHERE {where})" if where else "")
    value = f"CASE WHEN {where} THEN {args[0]} END" if where and args else args[0] if args else None
    if name == "count" and node.isDistinct() and len(args) == 1:
        return Aggregate(text, "distinct", value)
    if node.isDistinct():
        return Aggregate(text)
    if name in ("median", "mode") and len(args) == 1:
        return Aggregate(text, name, value)
    if name == "percentile" and len(args) == 2:
        try:
            return Aggregate(text, "median", value, float(args[1].rstrip("BDbdLlFf")))
        except ValueError:
            return Aggregate(text)
    return Aggregate(text)


def split(spark: SparkSession, text: str, first: int = 0) -> tuple[str, list[Aggregate]]:
    """The expression with ``_a0``, ``_a1``, … (from ``first``) for its aggregates, and these."""
    tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    found: list[Aggregate] = []
    places: list[str] = []

    def walk(node):
        if node.getClass().getSimpleName() == "UnresolvedFunction" and _is_aggregate(spark, node):
            found.append(_aggregate(node))
            places.append(node.sql())
            return
        for child in _children(node):
            walk(child)

    walk(tree)
    outer, at = tree.sql(), 0
    for i, written in enumerate(places):       # from left to right, as they stand
        at = outer.index(written, at)
        outer = f"{outer[:at]}_a{first + i}{outer[at + len(written):]}"
        at += len(f"_a{first + i}")
    return outer, found


def has_holistic(spark: SparkSession, *texts: str | None) -> bool:
    return any(a.kind for t in texts if t for a in split(spark, t)[1])


def _counts(rows: DataFrame, places: Sequence[str], groups: Column, names: Sequence[str], value: str) -> DataFrame:
    """(names, _x, _n): rows of each group and value."""
    counts = rows.groupBy(*[F.col(f"`{c}`") for c in places], F.expr(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    return (counts.filter("_x IS NOT NULL").select(F.inline(groups), "_x", "_n")
            .groupBy(*names, "_x").agg(F.sum("_n").alias("_n")))


def evaluate(rows: DataFrame, expressions: Mapping[str, str], places: Sequence[str], groups: Column,
             names: Sequence[str]) -> DataFrame:
    """(names, expressions): every expression for every group of the columns ``places``.

    ``groups`` is an array of structs of ``names``, as in ``quantiles``.
    """
    spark, outer, aggregates = rows.sparkSession, {}, []
    for name, text in expressions.items():
        outer[name], more = split(spark, text, len(aggregates))
        aggregates += more
    plain = [F.expr(a.text).alias(f"_a{i}") for i, a in enumerate(aggregates) if not a.kind]
    out = rows.select("*", F.inline(groups)).groupBy(*names).agg(F.count(F.lit(1)).alias("_rows"), *plain)
    for i, a in enumerate(aggregates):
        column = f"_a{i}"
        if a.kind == "median":
            value = F.expr(a.value).cast("double")
            part = quantiles.Histogram(rows, places, value).quantiles(groups, names, [a.share]).select(*names, F.col("q").alias(column))
        elif a.kind == "mode":
            part = _counts(rows, places, groups, names, a.value).groupBy(*names).agg(F.min_by("_x", F.struct(-F.col("_n"), "_x")).alias(column))
        elif a.kind == "distinct":
            part = _counts(rows, places, groups, names, a.value).groupBy(*names).agg(F.count("_x").alias(column))
        else:
            continue
        right = part.select(*[F.col(n).alias(f"_r{n}") for n in names], column)
        out = out.join(right, reduce(and_, [F.col(n).eqNullSafe(F.col(f"_r{n}")) for n in names]), "left").drop(*[f"_r{n}" for n in names])
        if a.kind == "distinct":
            out = out.withColumn(column, F.coalesce(column, F.lit(0).cast("bigint")))
    return out.select(*names, *[F.expr(text).alias(name) for name, text in outer.items()], "_rows")
