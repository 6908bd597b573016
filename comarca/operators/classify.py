"""Map classes, histograms, rankings and legends of a result.

Class limits are a handful of numbers, computed on the cluster and used as a scalar
subquery: no result is brought to the driver to be classed.

Conventions of the methods (limits always run from the minimum to the maximum, repeated
limits are merged, so no class is empty of width):

* ``equal``     equal widths
* ``quantile``  interpolated quantiles (position p·(n-1)), exact
* ``stddev``    mean ± half-integer multiples of the population standard deviation
* ``jenks``     least squared deviation within classes (no other limits have less), limits are
  class maxima

``jenks`` and ``quantile`` count the distinct values when they are called (their limits
depend on them); the others only declare a plan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from comarca.fixed_values import (
    CLASS_COUNT, CLASSIFICATIONS, MODAL_ROWS, RANKING_ROWS,
)
from comarca.functions.text import format_number
from comarca.operators.codebook import with_value_labels
from comarca.operators.lineage import cut
from comarca.operators.numbering import numbered
from comarca.operators.quantiles import quantiles
from comarca.spec import IndicatorSpec

JENKS_BINS = 256         # equal bins between minimum and maximum, to begin with
_PARTS = 8               # of a bin that is looked at more closely


def _numbers(result: DataFrame, value: str) -> DataFrame:
    """(v, n): the usable values of a result and how many territories have each."""
    v = F.col(value).try_cast("double")
    return (result.select(v.alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
            .groupBy("v").agg(F.count(F.lit(1)).alias("n")))


def class_edges(result: DataFrame, method: str = "jenks", n_classes: int = CLASS_COUNT,
                value: str = "valor") -> DataFrame:
    """One row (edges array<double>): increasing class limits; empty without values."""
    if method not in CLASSIFICATIONS:
        raise ValueError(f"unknown classification {method!r}; use one of {CLASSIFICATIONS}")
    counts = _numbers(result, value)
    if method in ("quantile", "jenks"):
        counts = cut(counts)     # what follows reads this, not the result
    distinct = counts.agg(F.count(F.lit(1)).alias("k")).scalar()
    weight, v = F.col("n").cast("double"), F.col("v")
    mean = F.sum(v * weight) / F.sum(weight)
    summary = counts.agg(F.min("v").alias("low"), F.max("v").alias("high"),
                         mean.alias("mean")).withColumn(
        "k", F.least(distinct, F.lit(int(n_classes))))
    nothing = F.array().cast("array<double>")
    low, high, k = F.col("low"), F.col("high"), F.col("k")
    if method == "equal":
        cuts = F.transform(F.sequence(F.lit(1), k), lambda i: low + i * ((high - low) / k))
    elif method == "quantile":
        n = min(counts.count(), n_classes)
        found = quantiles(counts, [], F.col("v"), [i / n for i in range(1, n)] or [0.5], F.col("n"))
        summary = summary.withColumn("cuts", found.agg(F.collect_list("q").alias("q")).scalar())
        cuts = F.col("cuts")
    elif method == "stddev":
        centre = counts.agg(mean.alias("mean")).scalar()
        spread = F.sqrt(F.sum(weight * F.pow(v - centre, F.lit(2.0))) / F.sum(weight))
        summary = summary.withColumn("sd", counts.agg(spread.alias("sd")).scalar())
        cuts = F.transform(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))),
                           lambda i: F.col("mean") + (i - k / 2) * F.col("sd"))
    else:
        cuts = F.array(*map(F.lit, _jenks_cuts(counts, n_classes))).cast("array<double>")
    inside = F.filter(F.coalesce(cuts, nothing), lambda c: (c > low) & (c < high) & (k > 1))
    all_edges = F.array_sort(F.array_distinct(F.concat(F.array(low, high), inside)))
    return summary.select(F.when(low.isNull(), nothing).otherwise(all_edges).alias("edges"))


def _jenks_cuts(counts: DataFrame, n_classes: int, bins: int = JENKS_BINS) -> list[float]:
    """Inner Jenks limits of (v, n): no other limits have less squared deviation.

    The values are summarised in bins (ends, weight, mean, squared deviation).  Cuts
    between bins give the deviation that has to be beaten; a lower bound says for each bin
    whether a cut inside it could beat it.  The bins where one could are split in parts,
    until there are none with two values: then the cuts found are the best of all.  The
    driver sees bins, never values, and far from the cuts they stay as they are.
    """
    counts = counts.filter(F.abs("v") < float("inf"))
    ends = counts.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    if ends.low is None:
        return []
    at = counts.withColumns({"low": F.lit(ends.low), "high": F.lit(ends.high), "parts": F.lit(bins), "bin": F.lit(0)})
    done, rows = 0, {}
    while True:
        # halves, so that the width of the widest bin is finite
        share = F.try_divide(F.col("v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)
        part = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.col("parts")), F.col("parts") - 1).cast("int")
        at = at.withColumn("bin", F.lit(done) + F.col("bin") * F.col("parts") + part)
        w, v = F.col("n").cast("double"), F.col("v")
        new = (at.withColumn("ref", F.col("low") / 2 + F.col("high") / 2)
               .groupBy("bin").agg(
                   F.min("v").alias("from"), F.max("v").alias("to"), F.sum(w).alias("w"), F.max("ref").alias("ref"),
                   F.sum((v - F.col("ref")) * w).alias("s1"), F.sum((v - F.col("ref")) * (v - F.col("ref")) * w).alias("s2")).collect())
        for r in new:
            mean = min(max(r.ref + r.s1 / r.w, r["from"]), r["to"])
            rows[r.bin] = (r["from"], r["to"], r.w, mean, max(r.s2 - r.s1 * r.s1 / r.w, 0.0) if r["from"] < r["to"] else 0.0)
        ids = sorted(rows, key=lambda b: rows[b][1])
        table = np.array([rows[b] for b in ids])
        limits, _ = _least_squares_limits(table[:, 1], table[:, 2], table[:, 3], table[:, 4], n_classes)
        better = _could_be_better(table, n_classes) & (table[:, 0] < table[:, 1])
        split = [ids[i] for i in np.flatnonzero(better)]
        if not split:
            return [float(table[e - 1, 1]) for e in limits]
        done = max(ids) + 1
        parts = [(b, n, rows[b][0], rows[b][1], _PARTS) for n, b in enumerate(split)]
        for b in split:
            del rows[b]
        small = counts.sparkSession.createDataFrame(parts, "_b int, _n int, low double, high double, parts int")  # bins to split
        at = cut(at.drop("low", "high", "parts").join(F.broadcast(small), F.col("bin") == F.col("_b"))
                 .select("v", "n", "low", "high", "parts", F.col("_n").alias("bin")))


class _Moments:
    """Weights, means and squared deviations of neighbouring bins, by running sums."""

    def __init__(self, w, mean, m2):
        self.w, self.m2 = np.asarray(w, np.longdouble), np.asarray(m2, np.longdouble)
        self.x = np.asarray(mean, np.longdouble)
        self.x = self.x - (self.w * self.x).sum() / self.w.sum()
        self.weight, self.first, self.second = (np.concatenate([[np.longdouble(0)], np.cumsum(c)])
                                                for c in (self.w, self.w * self.x, self.w * self.x ** 2 + self.m2))

    def cost(self, start, end):
        """Squared deviation of bins start..end-1 (arrays allowed; 0 of none)."""
        weight = self.weight[end] - self.weight[start]
        first = self.first[end] - self.first[start]
        spread = self.second[end] - self.second[start] - first ** 2 / np.where(weight > 0, weight, 1)
        return np.where(weight > 0, np.maximum(spread, 0), 0)


def _least_squares_limits(top, w, mean, m2, n_classes: int) -> tuple[list[int], float]:
    """Where classes of least squared deviation end (numbers of bins), and that deviation.

    Divide and conquer: the best start of a last class moves one way only as its end does, so
    a layer costs n log n.
    """
    size = len(top)
    k = min(n_classes, size)
    sums = _Moments(w, mean, m2)
    best = np.concatenate([[np.longdouble(0)], sums.cost(np.zeros(size, int), np.arange(1, size + 1))])
    came = []
    for classes in range(2, k + 1):
        nxt, back = np.full(size + 1, np.inf, np.longdouble), np.zeros(size + 1, int)
        todo = [(classes, size, classes - 1, size - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            end = (lo + hi) // 2
            starts = np.arange(first, min(last, end - 1) + 1)
            total = best[starts] + sums.cost(starts, end)
            pick = int(np.argmin(total))
            nxt[end], back[end] = total[pick], starts[pick]
            todo += [(lo, end - 1, first, starts[pick]), (end + 1, hi, starts[pick], last)]
        came.append(back)
        best = nxt
    ends, end = [], size
    for back in reversed(came):
        end = int(back[end])
        ends.append(end)
    return sorted(ends), float(max(best[size], 0))


def _could_be_better(table: np.ndarray, n_classes: int) -> np.ndarray:
    """Bins (from, to, w, mean, m2) inside which a cut could beat all cuts between bins.

    Of a bin that is cut, p goes to the class before and the rest to the one after.  Added to
    a class of weight W below the bin, p costs at least p W / (p + W) times the square of the
    distance from the class's mean to the bin's lower end, and the same from above; both are
    concave in p, so their sum is least where all of the bin goes one way, as if at that end.
    A class with both its outer bins at the near ends therefore costs no less than any way to
    cut inside them, and the best classes of that kind with a limit at a place bound all
    solutions with a cut in the bins beside it.
    """
    low, high, w, mean, m2 = table.T
    size = len(w)
    k = min(n_classes, size)
    if k < 2:
        return np.zeros(size, bool)
    sums = _Moments(w, mean, m2)
    shift = np.longdouble((w.astype(np.longdouble) * mean).sum() / w.sum(dtype=np.longdouble))
    near_low, near_high = low - shift, high - shift      # of its last bin, of its first bin
    _, target = _least_squares_limits(high, w, mean, m2, n_classes)

    def relaxed(start, end):
        """Least cost of a class of bins start..end-1 whose outer bins may be cut."""
        a = start + (start > 0)                          # bins that are surely whole: a..b-1
        b = end - (end < size)
        inner = np.where(b > a, sums.weight[np.maximum(b, a)] - sums.weight[a], 0)
        centre = np.where(inner > 0, (sums.first[np.maximum(b, a)] - sums.first[a]) / np.where(inner > 0, inner, 1), 0)
        cost = sums.cost(a, np.maximum(b, a))
        for outer, edge, there in ((start, near_high, start > 0), (end - 1, near_low, end < size)):
            joined = np.where(there & (inner > 0), sums.w[outer] * inner / (sums.w[outer] + inner) * (edge[outer] - centre) ** 2, 0)
            cost = cost + joined
        return cost.astype(float)

    # by where they end or begin, for every number of classes
    ahead, behind = np.full((k + 1, size + 1), np.inf), np.full((k + 1, size + 1), np.inf)
    ahead[0, 0] = behind[0, size] = 0
    for at in range(1, size + 1):
        starts = np.arange(at)
        ahead[1:, at] = (ahead[:-1, :at] + relaxed(starts, np.full(at, at))).min(axis=1)
    for at in range(size - 1, -1, -1):
        ends = np.arange(at + 1, size + 1)
        behind[1:, at] = (behind[:-1, at + 1:] + relaxed(np.full(len(ends), at), ends)).min(axis=1)
    through = np.min([ahead[c] + behind[k - c] for c in range(1, k)], axis=0)   # by the place of a limit
    bound = np.minimum(through[:-1], through[1:])        # a cut in a bin counts as one on either side
    return bound < target + 1e-12 * float(sums.cost(0, size))


# --- classes --------------------------------------------------------------------

def class_bounds(result: DataFrame, method: str = "jenks", n_classes: int = CLASS_COUNT,
                 value: str = "valor", edges: DataFrame | None = None) -> DataFrame:
    """(clase, desde, hasta) from 1 up.  One class when all values are equal.

    ``edges``, here and below, are limits of ``class_edges`` that are there already.
    """
    edges = edges if edges is not None else class_edges(result, method, n_classes, value)
    return _bounds(edges).select("clase", "desde", "hasta")


def _bounds(edges: DataFrame) -> DataFrame:
    e = F.col("edges")
    pairs = (F.when(F.size(e) == 0, F.array().cast("array<struct<desde:double,hasta:double>>"))
             .when(F.size(e) == 1, F.array(F.struct(e[0].alias("desde"), e[0].alias("hasta"))))
             .otherwise(F.transform(
                 F.sequence(F.lit(0), F.greatest(F.size(e) - 2, F.lit(0))),
                 lambda i: F.struct(F.get(e, i).alias("desde"),
                                    F.get(e, i + 1).alias("hasta")))))
    return (edges.select(F.posexplode(pairs).alias("pos", "c"))
            .select((F.col("pos") + 1).alias("clase"), "c.desde", "c.hasta"))


def class_of(value: Column, edges: Column) -> Column:
    """The class a value is drawn in: the first whose closed interval holds it."""
    below = F.size(F.filter(edges, lambda e: e < value))
    inside = (value >= F.get(edges, F.lit(0))) & (value <= F.get(edges, F.size(edges) - 1))
    return F.when(inside, F.greatest(below, F.lit(1)))


def class_label(desde: Column, hasta: Column) -> Column:
    """"from – to" with at most two decimals."""
    return F.concat(format_number(desde), F.lit(" – "), format_number(hasta))


def with_class(result: DataFrame, method: str = "jenks", n_classes: int = CLASS_COUNT,
               value: str = "valor", edges: DataFrame | None = None) -> DataFrame:
    """Add ``clase`` (1 up) and ``rango`` ("from – to"); NULL where there is no value."""
    limits = (edges if edges is not None
              else class_edges(result, method, n_classes, value)).scalar()
    v, e = F.col(value).try_cast("double"), F.col("_edges")
    out = result.withColumn("_edges", limits).withColumn("clase", class_of(v, e))
    label = class_label(F.get(e, F.col("clase") - 1),
                        F.get(e, F.least(F.col("clase"), F.size(e) - 1)))
    return out.withColumn("rango", label).drop("_edges")


def histogram(result: DataFrame, method: str = "jenks", n_classes: int = CLASS_COUNT,
              value: str = "valor", edges: DataFrame | None = None) -> DataFrame:
    """(clase, desde, hasta, n): territories per class of the map.

    Intervals are closed on the left, the last one on both sides.  No rows when all
    values are equal.
    """
    edges = edges if edges is not None else class_edges(result, method, n_classes, value)
    limits = edges.scalar()
    bins = _bounds(edges.filter(F.size("edges") > 1))
    at = F.least(F.size(F.filter("_edges", lambda e: e <= F.col("v"))), F.size("_edges") - 1)
    per_bin = (_numbers(result, value).withColumn("_edges", limits)
               .select(at.alias("_at"), "n")
               .groupBy("_at").agg(F.sum("n").alias("n")))
    return (bins.join(per_bin, F.col("clase") == F.col("_at"), "left")
            .select("clase", "desde", "hasta", F.coalesce("n", F.lit(0)).alias("n")))


def shared_classes(layers: DataFrame, layer: str, method: str = "jenks",
                   n_classes: int = CLASS_COUNT, value: str = "valor") -> DataFrame:
    """Classes computed on the layer with most features and applied to all layers.

    So that a colour means the same in each.  A value outside those limits has no class.
    """
    sizes = layers.groupBy(layer).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.min_by(F.col(layer), F.struct(-F.col("n"), F.col(layer)))
                        .alias("l")).scalar()
    main = layers.filter(F.col(layer) == largest)
    return with_class(layers, value=value, edges=class_edges(main, method, n_classes, value))


# --- views ----------------------------------------------------------------------

def modal_frequencies(result: DataFrame, labels: DataFrame | None = None,
                      rows: int = MODAL_ROWS) -> DataFrame:
    """(valor, texto, n, barra): territories per modal category, most frequent first.

    ``barra`` is the share of territories in whole percent.
    """
    counts = result.groupBy(F.col("valor").cast("string").alias("valor")).agg(
        F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).scalar()
    share = F.floor(F.col("n") * F.lit(100.0) / F.greatest(total, F.lit(1))).cast("int")
    top = (counts.withColumn("barra", share)
           .orderBy(F.col("n").desc(), F.col("valor").asc()).limit(rows))
    if labels is None:
        top = top.withColumn("texto", F.col("valor"))
    else:
        top = with_value_labels(top, "valor", labels)
    return (top.select("valor", "texto", "n", "barra")
            .orderBy(F.col("n").desc(), F.col("valor").asc()))


def ranking(result: DataFrame, rows: int = RANKING_ROWS, value: str = "valor",
            name: str = "geo_nombre") -> DataFrame:
    """(geo_code, nombre, valor, barra): the highest values, with a bar from 1 to 100.

    Bars start at zero, or at the minimum when there are negative values.
    """
    v = F.col(value).try_cast("double")
    label = F.col(name) if name in result.columns else F.col("geo_code")
    usable = (result.select("geo_code", label.alias("nombre"), v.alias("valor"))
              .filter("valor IS NOT NULL AND NOT isnan(valor)"))
    low = usable.agg(F.min("valor").alias("v")).scalar()
    high = usable.agg(F.max("valor").alias("v")).scalar()
    base = F.least(low, F.lit(0.0))
    width = F.coalesce(F.nullif(high - base, F.lit(0.0)), F.lit(1.0))
    fill = F.floor((F.col("valor") - base) / width * 100).cast("int")
    return (usable.orderBy(F.col("valor").desc(), F.col("geo_code").asc()).limit(rows)
            .withColumn("barra", F.greatest(F.lit(1), F.least(F.lit(100), fill))))


def category_legend(result: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(codigo, valor, texto): legend entries of a categorical map, by value."""
    values = (result.filter("valor IS NOT NULL")
              .select(F.col("valor").cast("string").alias("valor")).distinct())
    coded = numbered(values, "valor", "codigo")
    if labels is None:
        return coded.select("codigo", "valor", F.col("valor").alias("texto"))
    return with_value_labels(coded, "valor", labels).select("codigo", "valor", "texto")


def summary_view(result: DataFrame, spec: IndicatorSpec, method: str = "jenks",
                 labels: DataFrame | None = None, view: str | None = None,
                 rows: int | None = None) -> DataFrame:
    """What to show of a result: (vista, orden, texto, valor, quedan_fuera).

    ``view``: "frecuencias" (of a mode), "histograma" of the map classes, or "ranking";
    by default what fits the kind of indicator: frequencies of a mode, the histogram at
    unit level, else the ranking.  ``rows`` of frequencies or ranking are shown;
    ``quedan_fuera`` counts those that are not.
    """
    view = view or ("frecuencias" if spec.is_categorical_map else "histograma" if spec.level == "unidad" else "ranking")
    if view == "frecuencias":
        shown = rows or MODAL_ROWS
        counted = modal_frequencies(result, labels, shown)
        out = counted.select(F.row_number().over(Window.orderBy(F.col("n").desc(), "valor")).alias("orden"),
                             "texto", F.col("n").cast("double").alias("valor"))
        all_ = result.agg(F.count_distinct(F.coalesce(F.col("valor").cast("string"), F.lit("\0")))).scalar()
    elif view == "histograma":
        out = histogram(result, method).select(
            F.col("clase").alias("orden"), class_label(F.col("desde"), F.col("hasta")).alias("texto"),
            F.col("n").cast("double").alias("valor"))
        shown, all_ = 0, F.lit(0)
    elif view == "ranking":
        shown = rows or RANKING_ROWS
        out = ranking(result, shown).select(
            F.row_number().over(Window.orderBy(F.col("valor").desc(), "geo_code")).alias("orden"),
            F.col("nombre").alias("texto"), "valor")
        all_ = _numbers(result, "valor").agg(F.sum("n").alias("n")).scalar()
    else:
        raise ValueError(f"unknown view {view!r}")
    return out.select(F.lit(view).alias("vista"), "orden", "texto", "valor",
                      F.greatest(all_ - shown, F.lit(0)).cast("bigint").alias("quedan_fuera"))
