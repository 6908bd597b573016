"""The measures: one value and its number of cases per territory.

Three shapes of plan, chosen by the measure:

* counts, means, sums, deviations and percentages are sums of partial results.  Rows
  are aggregated on the raw territory columns (cheap keys, combined before the
  shuffle); codes are derived on that small table and its rows merged.  The reference
  value of the whole territory is one more merge of the same small table, so value,
  reference and coverage come from one scan.
* medians come from histograms of each territory (see ``quantiles``): what is shuffled are
  territories times buckets, never values.  The first histogram is taken when the
  function is called.
* modes count rows per territory *and* value first.  The shuffle is on both, so a
  territory holding a third of the rows is spread over many tasks, and no task ever
  holds a territory's values whole.
* a free expression is whatever Spark aggregate the caller writes; its medians,
  percentiles, modes and distinct counts are computed as above (see ``expressions``).

A batch adds up partial results on the territory columns once, whatever territories and
levels its specs ask for; filters and codes are applied to that small table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from comarca.functions.codes import category_eq, number
from comarca.operators import expressions, quantiles
from comarca.operators.territory import geo_code, scope, source_columns, territory_condition
from comarca.sources.tables import GeoColumns
from comarca.spec import COUNT, PERCENTAGES, SHEET_MEASURES, IndicatorSpec

_MERGED = (COUNT, "mean", "sum", "std") + PERCENTAGES
_NUMERIC = ("mean", "sum", "std")


def _scope(df: DataFrame, spec: IndicatorSpec, geo: GeoColumns,
           universe: Column | None) -> DataFrame:
    if spec.expression is None and spec.measure in SHEET_MEASURES:
        raise ValueError(f"{spec.measure} is a sheet measure: use sheet_indicator")
    return scope(df, spec, geo, universe)


# --- partial results ----------------------------------------------------------

def _partials(rows: DataFrame, spec: IndicatorSpec, tag: str = "") -> list[Column]:
    """Aggregates whose merge gives the measure."""
    out = []
    if spec.variable:
        out.append(F.count(F.col(f"`{spec.variable}`")).alias(f"valid{tag}"))
    if spec.category is not None:
        out.append(F.count_if(category_eq(rows, spec.variable, spec.category))
                   .alias(f"hits{tag}"))
    if spec.measure in _NUMERIC:
        x = number(rows, spec.variable)
        out += [F.count(x).alias(f"num{tag}"), F.sum(x).alias(f"sum{tag}")]
        if spec.measure == "std":
            out.append((F.var_pop(x) * F.count(x)).alias(f"m2{tag}"))
    return out


def _merge(partials: DataFrame, keys: Sequence[str], specs: Mapping[str, IndicatorSpec]
           ) -> DataFrame:
    """Partial results added up per key (no keys: one row for everything)."""
    if not keys and any(s.measure == "std" for s in specs.values()) and "_bucket" not in partials.columns:
        # first to a bounded number of rows, each around its own centre
        partials = _merge(partials.withColumn("_bucket", F.pmod(F.hash(*partials.columns), F.lit(256))), ["_bucket"], specs)
    merged = [F.sum("n").alias("n")]
    for tag, spec in specs.items():
        if spec.variable:
            merged.append(F.sum(f"valid{tag}").alias(f"valid{tag}"))
        if spec.category is not None:
            merged.append(F.sum(f"hits{tag}").alias(f"hits{tag}"))
        if spec.measure in _NUMERIC:
            merged += [F.sum(f"num{tag}").alias(f"num{tag}"),
                       F.sum(f"sum{tag}").alias(f"sum{tag}")]
        if spec.measure == "std":
            # Squares around the merged mean: within each part, plus between parts.
            same = Window.partitionBy(*keys)
            partials = partials.withColumn(f"centre{tag}", F.try_divide(
                F.sum(f"sum{tag}").over(same), F.sum(f"num{tag}").over(same)))
            own = F.try_divide(F.col(f"sum{tag}"), F.col(f"num{tag}"))
            merged.append(F.sum(F.col(f"m2{tag}") + F.col(f"num{tag}")
                                * F.pow(own - F.col(f"centre{tag}"), F.lit(2.0)))
                          .alias(f"m2{tag}"))
    out = partials.groupBy(*keys).agg(*merged)
    if keys:
        return out
    zero = [c for c in out.columns if c == "n" or c.startswith(("valid", "hits", "num"))]
    return out.fillna(0, subset=zero)


def _value(spec: IndicatorSpec, tag: str = "") -> tuple[Column, Column, Column]:
    """(valor, casos, whether a territory appears) from merged partial results."""
    n = F.col("n")
    valid = F.col(f"valid{tag}")
    hits = F.col(f"hits{tag}")
    total, num = F.col(f"sum{tag}"), F.col(f"num{tag}")
    if spec.measure == COUNT:
        count = hits if spec.category is not None else n
        return count.cast("double"), count, count > 0
    if spec.measure in PERCENTAGES:
        base = valid if spec.measure == "pct_category" else n
        share = F.round(F.try_divide(hits * F.lit(100.0), base.cast("double")), 2)
        return share, base, F.lit(True)
    if spec.measure == "mean":
        return F.round(F.try_divide(total, num.cast("double")), 4), valid, valid > 0
    if spec.measure == "sum":
        return total, valid, valid > 0
    deviation = F.sqrt(F.try_divide(F.col(f"m2{tag}"), (num - 1).cast("double")))
    return F.when(num > 1, F.round(deviation, 4)), valid, valid > 0


def _partials_by_source(rows: DataFrame, level: str, geo: GeoColumns,
                        specs: Mapping[str, IndicatorSpec]) -> DataFrame:
    """Partial results per raw territory columns, with the code derived on them."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for tag, spec in specs.items():
        aggs += _partials(rows, spec, tag)
    raw = rows.groupBy(*[F.col(f"`{c}`") for c in source_columns(level, geo)]).agg(*aggs)
    names = [c for c in raw.columns if c not in source_columns(level, geo)]
    return raw.select(geo_code(level, geo).alias("geo_code"), *names)


# --- modes ----------------------------------------------------------------------

def _counts_by_value(rows: DataFrame, spec: IndicatorSpec, geo: GeoColumns | None
                     ) -> DataFrame:
    """(geo_code?, value, n, valid): rows and answers per territory and value.

    Counted on the columns as they are stored, which are the cheapest keys; codes are
    then derived on the counts.  Without ``geo`` there is no territory.
    """
    keys = source_columns(spec.level, geo) if geo else []
    variable = F.col(f"`{spec.variable}`")
    counts = rows.groupBy(*[F.col(f"`{c}`") for c in keys if c != spec.variable],
                          variable).agg(F.count(F.lit(1)).alias("n"))
    code = [geo_code(spec.level, geo).alias("geo_code")] if geo else []
    return counts.select(*code, variable.alias("value"), "n",
                         F.when(variable.isNotNull(), F.col("n")).otherwise(0).alias("valid"))


def _modes(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, valor, casos, n_total) from counts per value."""
    sizes = [F.coalesce(F.sum(c), F.lit(0)).alias(name)
             for c, name in (("n", "n_total"), ("valid", "casos"))]
    merged = counts.groupBy(*keys, "value").agg(F.sum("n").alias("n"),
                                                F.sum("valid").alias("valid"))
    best = F.min(F.when(F.col("value").isNotNull(),
                        F.struct((-F.col("n")).alias("rank"), F.col("value"))))
    return (merged.groupBy(*keys).agg(best.alias("best"), *sizes)
            .withColumn("valor", F.col("best.value")).drop("best"))


# --- medians --------------------------------------------------------------------

def _medians(rows: DataFrame, spec: IndicatorSpec, places: Sequence[str],
             groups: Column, names: list[str]) -> DataFrame:
    """(names, valor, casos, n_total) of groups made from the columns ``places``."""
    variable = F.col(f"`{spec.variable}`")
    found = quantiles.Histogram(rows, places, number(rows, spec.variable), variable.isNotNull())
    return _with_quantile(found, groups, names, 0.5)


def _with_quantile(found: quantiles.Histogram, groups: Column, names: list[str], p: float) -> DataFrame:
    q = found.quantiles(groups, names, [p]).select(
        *[F.col(n).alias(f"_{n}") for n in names], F.round("q", 4).alias("valor"))
    same = reduce(and_, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
    return (quantiles.sizes(found.sketch, groups, names).join(q, same, "left")
            .drop(*[f"_{n}" for n in names]))


# --- public operators -----------------------------------------------------------

def indicator(df: DataFrame, spec: IndicatorSpec, geo: GeoColumns | None = None,
              universe: Column | None = None) -> DataFrame:
    """Value and cases per territory: (geo_code, valor, casos).

    ``valor`` is DOUBLE, or the variable's own type for a mode.  A territory is absent
    where no row counts for it, except in percentages, which keep it with a NULL value
    and zero cases.  A mode tie goes to the smallest value.
    """
    geo = geo or GeoColumns.of(df)
    if spec.expression is not None:
        return indicator_expr(df, spec, geo, universe)
    rows = _scope(df, spec, geo, universe)
    if spec.measure in _NUMERIC + ("median", "mode"):
        rows = rows.filter(F.col(f"`{spec.variable}`").isNotNull())
    elif spec.measure == COUNT and spec.category is not None:
        rows = rows.filter(category_eq(rows, spec.variable, spec.category))
    if spec.measure == "mode":
        return _modes(_counts_by_value(rows, spec, geo), ["geo_code"]).select("geo_code", "valor", "casos")
    if spec.measure == "median":
        code = F.array(F.struct(geo_code(spec.level, geo).alias("geo_code")))
        return (_medians(rows, spec, source_columns(spec.level, geo), code, ["geo_code"])
                .select("geo_code", "valor", "casos"))
    specs = {"": spec}
    merged = _merge(_partials_by_source(rows, spec.level, geo, specs), ["geo_code"], specs)
    valor, casos, present = _value(spec)
    return merged.filter(present).select("geo_code", valor.alias("valor"),
                                         casos.alias("casos"))


def _at_least_one(found: DataFrame) -> DataFrame:
    """The row of a whole, or one without a value where there are no rows."""
    return found.agg(F.max("valor").alias("valor"), F.coalesce(F.max("casos"), F.lit(0)).alias("casos"))


def reference_value(df: DataFrame, spec: IndicatorSpec, geo: GeoColumns | None = None,
                    universe: Column | None = None) -> DataFrame:
    """The measure over the whole (filtered) territory: one row (valor, casos)."""
    geo = geo or GeoColumns.of(df)
    if spec.expression is not None:
        return reference_expr(df, spec, geo, universe)
    rows = _scope(df, spec, geo, universe)
    if spec.measure == "mode":
        return _modes(_counts_by_value(rows, spec, None), []).select("valor", "casos")
    if spec.measure == "median":
        found = _medians(rows, spec, [], *quantiles.whole()).select("valor", "casos")
        return _at_least_one(found)
    aggs = [F.count(F.lit(1)).alias("n")] + _partials(rows, spec)
    valor, casos, _ = _value(spec)
    return rows.agg(*aggs).select(valor.alias("valor"), casos.alias("casos"))


def indicator_report(df: DataFrame, spec: IndicatorSpec, geo: GeoColumns | None = None,
                     universe: Column | None = None) -> DataFrame:
    """Values, reference value and coverage together, from one scan.

    Rows: every territory, and one with ``es_total`` true for the whole.  Columns:
    es_total, geo_code, valor, casos, n_total (rows) and n_valid (rows with an answer;
    all rows when no variable is asked).  A free expression is computed for all
    territories and the whole by one rollup.
    """
    geo = geo or GeoColumns.of(df)
    rows = _scope(df, spec, geo, universe)
    out = ["es_total", "geo_code", "valor", "casos", "n_total", "n_valid"]
    total_code = F.lit(None).cast("string").alias("geo_code")
    if spec.expression is not None and expressions.has_holistic(df.sparkSession, *_free(spec).values()):
        wanted = _free(spec)
        groups = F.array(F.struct(F.lit(False).alias("_whole"), geo_code(spec.level, geo).alias("_code")),
                         F.struct(F.lit(True).alias("_whole"), F.lit(None).cast("string").alias("_code")))
        found = expressions.evaluate(rows, wanted, source_columns(spec.level, geo), groups, ["_whole", "_code"])
        casos = F.col("casos") if "casos" in wanted else F.lit(None).cast("bigint")
        return found.select(F.col("_whole").alias("es_total"), F.col("_code").alias("geo_code"), "valor", casos.alias("casos"),
                            F.col("_rows").alias("n_total"), F.col("_rows").alias("n_valid"))
    if spec.expression is not None:
        cases = F.expr(spec.cases_expression) if spec.cases_expression else F.lit(None).cast("bigint")
        both = rows.withColumn("geo_code", geo_code(spec.level, geo)).rollup("geo_code").agg(
            (F.grouping("geo_code") == 1).alias("es_total"), F.expr(spec.expression).alias("valor"),
            cases.alias("casos"), F.count(F.lit(1)).alias("n_total"))
        return both.withColumn("n_valid", F.col("n_total")).select(*out)
    valor, casos, present = _value(spec) if spec.measure in _MERGED else (None,) * 3
    cols = lambda: [valor.alias("valor"), casos.alias("casos"), F.col("n").alias("n_total"),
                    (F.col("valid") if spec.variable else F.col("n")).alias("n_valid")]
    if spec.measure in _MERGED:
        specs = {"": spec}
        partials = _partials_by_source(rows, spec.level, geo, specs)
        per = (_merge(partials, ["geo_code"], specs).filter(present)
               .select(F.lit(False).alias("es_total"), "geo_code", *cols()))
        whole = _merge(partials, [], specs).select(F.lit(True).alias("es_total"),
                                                   total_code, *cols())
        return per.unionByName(whole).select(*out)
    if spec.measure == "median":
        groups = F.array(F.struct(F.lit(False).alias("es_total"), geo_code(spec.level, geo).alias("geo_code")),
                         F.struct(F.lit(True).alias("es_total"), total_code))
        both = _medians(rows, spec, source_columns(spec.level, geo), groups, ["es_total", "geo_code"])
    else:
        counts = _counts_by_value(rows, spec, geo)
        everywhere = counts.groupBy("value").agg(F.sum("n").alias("n"),
                                                 F.sum("valid").alias("valid"))
        both = _modes(counts.withColumn("es_total", F.lit(False))
                      .unionByName(everywhere.withColumns({"es_total": F.lit(True),
                                                           "geo_code": total_code})), ["es_total", "geo_code"])
    return (both.filter("casos > 0 OR es_total")
            .withColumn("n_valid", F.col("casos")).select(*out))


def indicator_expr(df: DataFrame, spec: IndicatorSpec, geo: GeoColumns | None = None,
                   universe: Column | None = None) -> DataFrame:
    """A free Spark aggregate per territory; ``casos`` only when its expression is given."""
    geo = geo or GeoColumns.of(df)
    rows = _scope(df, spec, geo, universe)
    wanted = _free(spec)
    if expressions.has_holistic(df.sparkSession, *wanted.values()):
        groups = F.array(F.struct(geo_code(spec.level, geo).alias("_code")))
        found = expressions.evaluate(rows, wanted, source_columns(spec.level, geo), groups, ["_code"])
        return found.select(F.col("_code").alias("geo_code"), *wanted)
    return (rows.groupBy(geo_code(spec.level, geo).alias("geo_code"))
            .agg(*[F.expr(text).alias(name) for name, text in wanted.items()]))


def _free(spec: IndicatorSpec) -> dict[str, str]:
    """The free expressions of a spec by the column they give."""
    return {"valor": spec.expression} | ({"casos": spec.cases_expression} if spec.cases_expression else {})


def reference_expr(df: DataFrame, spec: IndicatorSpec, geo: GeoColumns | None = None,
                   universe: Column | None = None) -> DataFrame:
    """A free Spark aggregate over the whole (filtered) territory: one row."""
    rows, wanted = scope(df, spec, geo or GeoColumns.of(df), universe), _free(spec)
    # without rows the whole still has a row, which plain aggregates give
    if expressions.has_holistic(df.sparkSession, *wanted.values()) and not rows.isEmpty():
        return expressions.evaluate(rows, wanted, [], *quantiles.whole()).select(*wanted)
    return rows.agg(*[F.expr(text).alias(name) for name, text in wanted.items()])


def _territories(rows: DataFrame, scopes: Sequence[tuple], geo: GeoColumns):
    """Columns that say which of ``scopes`` (level, department, municipality, area) a row is
    in, conditions of being in each, and each one's code."""
    places: dict[str, None] = {}
    conditions, codes = [], []
    for level, department, municipality, area in scopes:
        asked = territory_condition(rows, department, municipality, area, geo)
        places.update(dict.fromkeys([*source_columns(level, geo), *(c for c, _ in asked)]))
        conditions.append(reduce(and_, [c for _, c in asked], F.lit(True)))
        codes.append(geo_code(level, geo))
    return list(places), conditions, codes


def _members(cells: Sequence[tuple[Column, dict[str, Column]]]) -> Column:
    """The fields of all cells whose condition holds, as an array of structs."""
    every = F.array(*[F.struct(F.coalesce(condition, F.lit(False)).alias("_in"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("_f"))
                      for condition, fields in cells])
    return F.transform(F.filter(every, lambda x: x["_in"]), lambda x: x["_f"])


def indicator_batch(df: DataFrame, specs: Mapping[str, IndicatorSpec],
                    geo: GeoColumns | None = None,
                    universe: Column | None = None) -> DataFrame:
    """Many indicators of one table: (indicador, geo_code, valor, casos).

    Specs may differ in level, territory, area, variable and measure; year and table are
    shared.  Everything that merges is one aggregation on the territory columns over one
    scan, each (measure, variable, category) once, however many territories ask for it;
    medians share one histogram, modes one count, and free expressions one aggregation.
    ``valor`` is DOUBLE; modes stand in one more column, ``categoria``, which is there if
    any mode is asked for.
    """
    geo = geo or GeoColumns.of(df)
    if len({(s.year, s.table) for s in specs.values()}) != 1:
        raise ValueError("batched indicators share year and table")
    one = next(iter(specs.values()))
    rows = scope(df, IndicatorSpec(year=one.year, table=one.table), geo, universe)
    for spec in specs.values():
        if spec.expression is None and spec.measure in SHEET_MEASURES:
            raise ValueError(f"{spec.measure} is a sheet measure: use sheet_batch")
    scopes = list(dict.fromkeys((s.level, s.department, s.municipality, s.area) for s in specs.values()))
    scope_of = {name: scopes.index((s.level, s.department, s.municipality, s.area)) for name, s in specs.items()}
    places, conditions, codes = _territories(rows, scopes, geo)
    if all(any(x is not None for x in s[1:]) for s in scopes):
        rows = rows.filter(reduce(or_, conditions))    # what no spec asks for is not read
    place = [F.col(f"`{c}`") for c in places]
    scoped = _members([(conditions[k], {"_scope": F.lit(k), "_code": codes[k]}) for k in range(len(scopes))])
    parts = []

    def named(kind):
        return {name: s for name, s in specs.items()
                if (s.expression is not None if kind == "free" else s.expression is None and s.measure in kind)}

    def own(cells):
        """The cells of the specs that a row's scope is asked for by."""
        return F.filter(F.array(*cells), lambda c: (c["_scope"] == F.col("_scope")) & c["present"])

    merging = named(_MERGED)
    if merging:
        tags: dict[tuple, str] = {}
        for s in merging.values():
            tags.setdefault((s.measure, s.variable, s.category), f"_{len(tags)}")
        tagged = {tags[s.measure, s.variable, s.category]: s for s in merging.values()}
        aggs = [F.count(F.lit(1)).alias("n")]
        for tag, s in tagged.items():
            aggs += _partials(rows, s, tag)
        raw = rows.groupBy(*place).agg(*aggs)
        merged = _merge(raw.select(F.inline(scoped), *[c for c in raw.columns if c not in places]), ["_scope", "_code"], tagged)
        cells = []
        for name, s in merging.items():
            valor, casos, present = _value(s, tags[s.measure, s.variable, s.category])
            cells.append(F.struct(F.lit(name).alias("indicador"), F.lit(scope_of[name]).alias("_scope"), valor.alias("valor"),
                                  casos.alias("casos"), present.alias("present")))
        parts.append(merged.select(F.col("_code").alias("geo_code"), F.explode(own(cells)).alias("c"))
                     .select("c.indicador", "geo_code", "c.valor", "c.casos"))
    free = named("free")
    if free:
        cells = F.array(*[F.struct(
            F.lit(name).alias("indicador"), F.lit(scope_of[name]).alias("_own"), F.expr(s.expression).cast("double").alias("valor"),
            (F.expr(s.cases_expression).cast("bigint") if s.cases_expression else F.lit(None).cast("bigint")).alias("casos"))
            for name, s in free.items()])
        asked = sorted({scope_of[name] for name in free})
        scopes_asked = _members([(conditions[k], {"_scope": F.lit(k), "_code": codes[k]}) for k in asked])
        parts.append(rows.select("*", F.inline(scopes_asked)).groupBy("_scope", "_code").agg(cells.alias("c"))
                     .select("_scope", F.col("_code").alias("geo_code"), F.inline("c")).filter("_scope = _own")
                     .select("indicador", "geo_code", "valor", "casos"))

    def by_variable(chosen):
        """Variables, the number of each, and the groups of a place and variable number."""
        variables = list(dict.fromkeys(s.variable for s in chosen.values()))
        return variables, _members([((F.col("_var") == variables.index(s.variable)) & conditions[scope_of[name]],
                                     {"indicador": F.lit(name), "geo_code": codes[scope_of[name]]}) for name, s in chosen.items()])

    modes = named(("mode",))
    if modes:
        # a value keeps its own order (the smallest wins a tie) beside its text
        variables, groups = by_variable(modes)
        cells = F.array(*[F.struct(F.lit(j).alias("_var"), number(rows, v).alias("order"), F.col(f"`{v}`").cast("string").alias("value"))
                          for j, v in enumerate(variables)])
        counts = (rows.select(*place, F.inline(cells)).filter("value IS NOT NULL")
                  .groupBy(*place, "_var", "order", "value").agg(F.count(F.lit(1)).alias("n"))
                  .select(F.inline(groups), "order", "value", "n")
                  .groupBy("indicador", "geo_code", "order", "value").agg(F.sum("n").alias("n")))
        best = F.min_by("value", F.struct(-F.col("n"), "order", "value"))
        parts.append(counts.groupBy("indicador", "geo_code").agg(best.alias("categoria"), F.sum("n").alias("casos"))
                     .select("indicador", "geo_code", F.lit(None).cast("double").alias("valor"), "casos", "categoria"))
    medians = named(("median",))
    if medians:
        variables, groups = by_variable(medians)
        cells = F.array(*[F.struct(F.lit(j).alias("_var"), number(rows, v).alias("_x"), F.col(f"`{v}`").isNotNull().alias("_answered"))
                          for j, v in enumerate(variables)])
        answers = rows.select(*place, F.inline(cells)).filter("_answered")
        found = quantiles.Histogram(answers, [*places, "_var"], F.col("_x"), F.lit(True))
        parts.append(_with_quantile(found, groups, ["indicador", "geo_code"], 0.5).select("indicador", "geo_code", "valor", "casos"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Levels of ``approximate_quantiles`` from the smallest up; the last is the whole table.
ROLLED_UP = ("unidad", "municipio", "departamento", "total")


def approximate_quantiles(df: DataFrame, spec: IndicatorSpec, probs: Sequence[float] = (0.5,), accuracy: float = 0.01,
                          geo: GeoColumns | None = None, universe: Column | None = None) -> DataFrame:
    """Quantiles within a share ``accuracy`` of the value: (nivel, geo_code, prob, valor, casos).

    One scan makes a sketch per territory of ``spec.level``; all levels above and the whole
    (nivel ``total``, geo_code NULL) are merged from it.  For values of one sign, valor is
    at most accuracy × |exact| from the exact interpolated quantile; where the two values it
    lies between differ in sign, accuracy × the larger of their sizes.
    """
    geo = geo or GeoColumns.of(df)
    rows = _scope(df, spec, geo, universe)
    levels = [lv for lv in ROLLED_UP[ROLLED_UP.index(spec.level):] if lv == "total" or _has_level(lv, geo)]
    code = {lv: F.lit(None).cast("string") if lv == "total" else geo_code(lv, geo) for lv in levels}
    places = list(dict.fromkeys(c for lv in levels if lv != "total" for c in source_columns(lv, geo)))
    groups = F.array(*[F.struct(F.lit(lv).alias("nivel"), code[lv].alias("geo_code")) for lv in levels])
    names, x = ["nivel", "geo_code"], number(rows, spec.variable)
    sketches = quantiles.sketch(rows.filter(F.col(f"`{spec.variable}`").isNotNull()), places, x, quantiles.per_octave_for(accuracy))
    found = quantiles.estimates(sketches, groups, names, probs).select(F.col("nivel").alias("_l"), F.col("geo_code").alias("_g"), "i", "q")
    ps = F.array(*[F.lit(float(p)) for p in probs])
    return (quantiles.sizes(sketches, groups, names)
            .join(found, (F.col("nivel") == F.col("_l")) & F.col("geo_code").eqNullSafe(F.col("_g")))
            .select("nivel", "geo_code", F.get(ps, F.col("i")).alias("prob"), F.col("q").alias("valor"), "casos"))


def _has_level(level: str, geo: GeoColumns) -> bool:
    try:
        source_columns(level, geo)
    except ValueError:
        return False
    return True


def coverage(df: DataFrame, variables: Sequence[str],
             by: Sequence[Column | str] = ()) -> DataFrame:
    """Rows and rows with an answer for many variables, in one pass.

    (by…, variable, n_total, n_valid): one row per variable.
    """
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.struct(*[F.count(F.col(f"`{v}`")).alias(str(i))
                   for i, v in enumerate(variables)]).alias("valid"))
    cells = F.array(*[F.struct(F.lit(v).alias("variable"),
                               F.col(f"valid.`{i}`").alias("n_valid"))
                      for i, v in enumerate(variables)])
    names = [c for c in counted.columns if c not in ("n_total", "valid")]
    return (counted.select(*names, "n_total", F.inline(cells))
            .select(*names, "variable", "n_total", "n_valid"))


def distinct_values(df: DataFrame, variable: str, limit: int | None = None) -> DataFrame:
    """(valor, n_valores): distinct values as ordered text, and how many there are.

    With ``limit`` the first so many; ``n_valores`` says what is left out.
    """
    values = (df.filter(F.col(f"`{variable}`").isNotNull())
              .select(F.col(f"`{variable}`").cast("string").alias("valor")).distinct())
    counted = values.withColumn("n_valores", values.agg(F.count(F.lit(1)).alias("n")).scalar()).orderBy("valor")
    return counted if limit is None else counted.limit(limit)
