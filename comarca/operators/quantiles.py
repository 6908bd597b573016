"""Quantiles of very large groups without shuffling their values.

A sketch is a histogram as rows: per place, how many values lie in each bucket of a
logarithmic scale, and the smallest and largest of them.  Rows are counted before the
shuffle, so what moves is at most places × buckets, and sketches merge by adding rows.

* Exact.  The counts say which bucket holds a rank.  The rows are read again, only values
  within such a bucket go on (a map-side join with the buckets found), and are counted in
  ``FINE`` equal parts of it; and so on until no bucket that holds a rank has more than
  ``ENOUGH`` rows or two different values.  Then its values are counted one by one.  The
  counts decide, the buckets only say where to look, so the result is exact.  With few
  different values the first pass is all there is.
* Approximate.  The middle of the bucket is within a stated share of the value (see
  ``estimates``): one pass, and levels above are merged from the same sketch.

Groups are arrays of structs, made from the columns of a place: a place can belong to
several groups (its municipality, its department, the whole).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from comarca.operators.lineage import cut

PER_OCTAVE = 32
_ZERO_AT = 1 << 26         # keeps every finite bucket on its own side of zero
FINE = 4096
#: Rows of a bucket that are counted value by value.
ENOUGH = 1 << 16
#: Buckets to look into that are broadcast (some 100 bytes each); more are joined as Spark sees fit.
SMALL = 500_000


def per_octave_for(accuracy: float) -> int:
    """Buckets per power of two whose middle is within ``accuracy`` (a share) of all in them."""
    if not 0 < accuracy < 1:
        raise ValueError("accuracy is a share between 0 and 1")
    return math.ceil(1 / math.log2((1 + accuracy) / (1 - accuracy)))


def _log_bucket(v: Column, per_octave: int) -> Column:
    size = F.floor(F.log2(F.abs(v)) * per_octave).cast("int") + _ZERO_AT
    inf = F.lit(float("inf"))
    return (F.when(F.isnan(v), 3 * _ZERO_AT)
            .when(v == inf, 2 * _ZERO_AT).when(v == -inf, -2 * _ZERO_AT)
            .when(v == 0, 0).when(v > 0, size).otherwise(-size))


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def _values(rows: DataFrame, places: Sequence[str], value: Column, answered: Column | None, weight: Column | None) -> DataFrame:
    """(places, _v, _a, _w): a value, whether there is an answer, and how many rows it stands for."""
    answered = value.isNotNull() if answered is None else answered
    return rows.select(*_columns(places), value.alias("_v"), answered.cast("int").alias("_a"),
                       *([] if weight is None else [weight.alias("_w")]))


def _sketched(values: DataFrame, places: Sequence[str], per_octave: int) -> DataFrame:
    w = F.col("_w") if "_w" in values.columns else F.lit(1)
    return (values.groupBy(*_columns(places), _log_bucket(F.col("_v"), per_octave).alias("_b"))
            .agg(F.sum(w).cast("bigint").alias("_rows"), F.sum(F.col("_a") * w).cast("bigint").alias("_valid"),
                 F.sum(F.when(F.col("_v").isNotNull(), w).otherwise(0)).cast("bigint").alias("_n"),
                 F.min("_v").alias("_low"), F.max("_v").alias("_high")))


def sketch(rows: DataFrame, places: Sequence[str], value: Column, per_octave: int = PER_OCTAVE,
           answered: Column | None = None) -> DataFrame:
    """A mergeable sketch: (places, _b, _rows, _valid, _n, _low, _high), a row per place and bucket."""
    return _sketched(_values(rows, places, value, answered, None), places, per_octave)


def merged(sketches: DataFrame, groups: Column, names: Sequence[str]) -> DataFrame:
    """The sketch of every group: (names, _b, …)."""
    return (sketches.select(F.inline(groups), "_b", "_rows", "_valid", "_n", "_low", "_high").groupBy(*names, "_b")
            .agg(*[F.sum(c).alias(c) for c in ("_rows", "_valid", "_n")], F.min("_low").alias("_low"), F.max("_high").alias("_high")))


def sizes(sketches: DataFrame, groups: Column, names: Sequence[str]) -> DataFrame:
    """(names, n_total, casos): rows and answers of every group."""
    return (sketches.select(F.inline(groups), "_rows", "_valid").groupBy(*names)
            .agg(F.sum("_rows").alias("n_total"), F.sum("_valid").alias("casos")))


def _stretch(rows: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """The rows that hold rank ``lo`` or ``hi``, which become relative to the row."""
    before = (F.sum("_n").over(Window.partitionBy(*within).orderBy(order)
                               .rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    return (rows.withColumn("_before", before).filter("_before <= hi AND _before + _n > lo")
            .withColumns({"lo": F.col("lo") - F.col("_before"), "hi": F.col("hi") - F.col("_before")}).drop("_before"))


def _holding(buckets: DataFrame, names: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(names, i, lo, hi, part, _n, _low, _high): the buckets that hold a quantile.

    A quantile lies between two neighbouring ranks, lo and hi (the same one when it needs
    no interpolation), so whatever holds either of them is one stretch.
    """
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    ranks = buckets.filter("_n > 0").withColumn("_total", F.sum("_n").over(Window.partitionBy(*names)))
    at = F.col("p") * (F.col("_total") - 1)
    ranks = (ranks.select("*", F.inline(asked))
             .withColumns({"lo": F.floor(at).cast("bigint"), "hi": F.ceil(at).cast("bigint"), "part": at - F.floor(at)}))
    return _stretch(ranks, [*names, "i"], "_b").select(*names, "i", "lo", "hi", "part", "_n", "_low", "_high")


def _interpolated(found: DataFrame, names: Sequence[str], low: Column, high: Column) -> DataFrame:
    q = F.when(low == high, low).otherwise(low + (high - low) * F.max("part"))
    return found.groupBy(*names, "i").agg(q.alias("q"))


def estimates(sketches: DataFrame, groups: Column, names: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(names, i, q): quantiles within the accuracy of the sketch, from the sketch alone.

    Each of the two values that a quantile lies between is estimated by 2ab / (a + b), with a
    and b the ends of its bucket: at most (b - a) / (b + a) of the value away, which the
    buckets per octave bound.
    """
    found = _holding(merged(sketches, groups, names), names, probs)
    a, b = F.col("_low"), F.col("_high")
    middle = F.when(a == b, a).otherwise(a * (b / (a + b)) * 2)
    found = found.withColumn("_m", middle)
    return _interpolated(found, names, F.min("_m"), F.max("_m"))


class Histogram:
    """Rows and the sketch of their values, from which exact quantiles of groups are found.

    ``value`` is DOUBLE; NULL is no value.  ``places`` are the columns that groups are made
    from.  The sketch is taken, and checkpointed, when the object is made.
    """

    def __init__(self, rows: DataFrame, places: Sequence[str], value: Column,
                 answered: Column | None = None, weight: Column | None = None):
        self.places = list(places)
        if not self.places:
            # one place; not a literal, so that joins on it stay joins on a key
            rows, self.places = rows.withColumn("_all", F.pmod(F.hash(value), F.lit(1))), ["_all"]
        self.values = _values(rows, self.places, value, answered, weight)
        self.sketch = cut(_sketched(self.values, self.places, PER_OCTAVE))

    def _look(self, found: DataFrame, groups: Column, names: Sequence[str], few: bool) -> DataFrame:
        """Values within the buckets ``found``, with their group and rank."""
        ours = [f"_p{i}" for i in range(len(self.places))]
        at = (self.sketch.select(*_columns(self.places)).distinct()
              .select(*[F.col(f"`{c}`").alias(o) for c, o in zip(self.places, ours)], F.inline(groups)))
        right = found.select(*[F.col(n).alias(f"_g_{n}") for n in names], "i", "lo", "hi", "part", "_low", "_high")
        same = reduce(and_, [F.col(n).eqNullSafe(F.col(f"_g_{n}")) for n in names])
        wanted = at.join(right, same).drop(*[f"_g_{n}" for n in names])
        values = self.values.select(*[F.col(f"`{c}`").alias(f"_q{i}") for i, c in enumerate(self.places)],
                                    "_v", F.col("_w") if "_w" in self.values.columns else F.lit(1).alias("_w"))
        place = reduce(and_, [F.col(f"_q{i}").eqNullSafe(F.col(o)) for i, o in enumerate(ours)])
        return values.join(F.broadcast(wanted) if few else wanted, place & F.col("_v").between(F.col("_low"), F.col("_high")))

    def quantiles(self, groups: Column, names: Sequence[str], probs: Sequence[float]) -> DataFrame:
        """(names, i, q): exact interpolated quantiles of every group; ``i`` is the place in ``probs``."""
        names = list(names)
        found = cut(_holding(merged(self.sketch, groups, names), names, probs))
        stretch = [*names, "i", "_low"]        # the buckets of a rank differ in their least value
        open_ = F.col("_low") < F.col("_high")
        while True:
            seen = found.agg(F.count(F.lit(1)).alias("k"), F.max(F.when(open_, F.col("_n"))).alias("n")).first()
            few = seen.k * len(probs) <= SMALL
            if seen.n is None or seen.n <= ENOUGH:
                break
            large = open_ & (F.col("_n") > ENOUGH)
            part = F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * FINE)
            finer = (self._look(found.filter(large), groups, names, few)
                     .groupBy(*stretch, "lo", "hi", "part", F.least(part, F.lit(FINE - 1)).alias("_f"))
                     .agg(F.sum("_w").cast("bigint").alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to")))
            finer = (_stretch(finer, stretch, "_f")
                     .select(*names, "i", "lo", "hi", "part", "_n", F.col("_from").alias("_low"), F.col("_to").alias("_high")))
            found = cut(found.filter(~large).unionByName(finer))
        known = found.filter(~open_).select(*names, "i", "part", F.col("_low").alias("_v"))
        if seen.n is not None:
            inside = (self._look(found.filter(open_), groups, names, few).groupBy(*stretch, "lo", "hi", "part", "_v")
                      .agg(F.sum("_w").cast("bigint").alias("_n")))
            known = known.unionByName(_stretch(inside, stretch, "_v").select(*names, "i", "part", "_v"))
        return _interpolated(known, names, F.min("_v"), F.max("_v"))


def whole(**names) -> tuple[Column, list[str]]:
    """(groups, names) of one group for all rows."""
    names = names or {"_whole": F.lit(0)}
    return F.array(F.struct(*[c.alias(n) for n, c in names.items()])), list(names)


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: Sequence[float],
              weight: Column | None = None) -> DataFrame:
    """(keys, i, q): exact interpolated quantiles per key straight from rows."""
    keys = list(keys)
    groups, names = (F.array(F.struct(*_columns(keys))), keys) if keys else whole()
    found = Histogram(df, keys, value, weight=weight).quantiles(groups, names, probs)
    return found.select(*keys, "i", "q")
