"""Whiten embeddings by their exact covariance, from bit-sliced cross-products.

* Integers.  A component c becomes x = floor(scale * c) + shift.  Every dimension is moved
  by its smallest value, which no covariance sees, so that few bits are left.
* Bit planes.  In a block of rows each bit of each dimension is a plane: one bit a row,
  packed into words of 64 rows.  The cross-product of two dimensions is the sum over pairs
  of their bits of 2 ** (bit + bit) times the ones in the AND of the two planes, so it is
  exact.  A task adds up its blocks and hands on one row per pair of dimensions.
* Centring.  n * (cross-product) - (sum) * (sum) is taken in integers of any length, and
  only then divided by n ** 2; eigh sees a matrix that has lost nothing to cancellation.
* Rows are projected as (x - mean) in doubles, with the integer part of the mean taken off
  as integers first.

What is gathered on the driver are the sums of dimensions and of their pairs; both have a
size that the vectors' length decides, not their number.

Defined results: vectors that are NULL, empty or hold NULL or non-finite entries take no
part, nor do those whose length is not the most frequent one (of equally frequent ones the
greatest) or that hold an x beyond +-2 ** 52, where doubles no longer count in ones;
repeated rows count each; a NULL id stays; of a component without variance (as when all
rows are equal) whitened is NULL, its explained share and the error 0; an empty table gives
no rows; other columns stay, but for those of a new column's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from comarca.llm.common import written

SCALE, SHIFT = 1024, 100_000
#: Entries beyond this are no integers a double can tell apart.
WIDEST = 1 << 52
#: Rows of a block, a multiple of 64.
BLOCK = 1 << 14
#: Sums are handed on in parts of so many bits: the parts of 2 ** 22 tasks add up to a long.
PART_BITS = 40


def integers(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vectors`` with ``x`` (array of long) in place of ``vector``: the rows that take part, as a table."""
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda c: c * F.lit(float(scale)))
    rows = vectors.select(*[c for c in vectors.columns if c not in (vector, "x")], scaled.alias("x"))
    rows = rows.where((F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= float(WIDEST))))
    rows = written(rows.withColumn("x", F.transform("x", lambda e: F.floor(e).cast("long") + F.lit(shift).cast("long"))))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual.d if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


_HALF = 26


def dimensions(rows: DataFrame) -> list[tuple[int, int, int, int]]:
    """(n, sum, smallest, greatest) of every dimension, in order; a sum is a Python integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                low = (x & ((1 << _HALF) - 1)).sum(axis=0)  # two halves, so that no sum overflows
                d = x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (
                    np.arange(d), np.full(d, len(x)), (x >> _HALF).sum(axis=0), low, x.min(axis=0), x.max(axis=0))],
                    ["d", "n", "upper", "lower", "low", "high"])

    parts = rows.select("x").mapInArrow(run, "d long, n long, upper long, lower long, low long, high long")
    sums = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("upper").alias("upper"), F.sum("lower").alias("lower"),
                                  F.min("low").alias("low"), F.max("high").alias("high"))
    return [(r.n, (r.upper << _HALF) + r.lower, r.low, r.high) for r in sorted(sums.collect(), key=lambda r: r.d)]


def bit_planes(y: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes (packed to words), and the dimension and bit of each, of a block of rows of
    numbers from 0 on; ``bits`` says how many each dimension has."""
    filled = np.zeros((-(-len(y) // 64) * 64, y.shape[1]), np.int64)
    filled[:len(y)] = y
    planes, of, bit = [], [], []
    for d, n in enumerate(bits):
        for b in range(n):
            planes.append(np.packbits((filled[:, d] >> b & 1).astype(bool)).view(np.uint64))
            of.append(d)
            bit.append(b)
    return np.array(planes, np.uint64).reshape(len(of), len(filled) // 64), np.array(of, np.int64), np.array(bit, np.int64)


def cross_products(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """Sums of products of every pair of dimensions (upper triangle) of a block, exact."""
    planes, of, bit = bit_planes(y, bits)
    kind = np.int64 if 2 * max(bits, default=0) + 1 + len(y).bit_length() < 63 else object
    out, weight = np.zeros((y.shape[1], y.shape[1]), kind), np.array([1 << b for b in bit.tolist()], kind)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    for i, first in enumerate(starts):
        last = starts[i + 1] if i + 1 < len(starts) else len(of)
        ones = sum(np.bitwise_count(planes[first:] & planes[p]).sum(axis=1, dtype=np.int64).astype(kind) * weight[p] for p in range(first, last))
        out[of[first], of[starts[i:]]] = np.add.reduceat(ones * weight[first:], starts[i:] - first)
    return out


def scatter(rows: DataFrame, low: list[int], bits: list[int]) -> dict[tuple[int, int], int]:
    """Sum of products of every pair of dimensions d <= e, each moved by its smallest value."""
    d, n_parts = len(low), -(-(2 * max(bits, default=0) + 64) // PART_BITS)
    upper, mask = np.triu_indices(d), (1 << PART_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.zeros((n_parts, len(upper[0])), np.int64)
        held, size = [], 0

        def add():
            left = cross_products(np.concatenate(held), bits)[upper]
            for i in range(n_parts):
                parts[i] += (left & mask).astype(np.int64)
                left = left >> PART_BITS

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(_matrix(batch.column(0).slice(at, BLOCK)) - np.array(low, np.int64))
                size += len(held[-1])
                if size >= BLOCK:
                    add()
                    held, size = [], 0
        if held:
            add()
        for i in range(n_parts):
            some = np.flatnonzero(parts[i])
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(upper[0][some]), pa.array(upper[1][some]), pa.array(np.full(len(some), i)), pa.array(parts[i][some])],
                                                 ["d", "e", "part", "v"])

    sums = rows.select("x").mapInArrow(run, "d long, e long, part long, v long").groupBy("d", "e", "part").agg(F.sum("v").alias("v"))
    out: dict[tuple[int, int], int] = {}
    for r in sums.collect():
        out[r.d, r.e] = out.get((r.d, r.e), 0) + (r.v << PART_BITS * r.part)
    return out


class Fit(NamedTuple):
    """What the rows of a fit list decide."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]
    covariance: np.ndarray
    values: np.ndarray      #: eigenvalues, falling
    vectors: np.ndarray     #: unit eigenvectors, one column each

    @property
    def explained(self) -> np.ndarray:
        total = np.trace(self.covariance)
        return self.values / total if total > 0 else np.zeros(len(self.values))

    @property
    def varies(self) -> np.ndarray:
        return self.values > np.trace(self.covariance) * len(self.values) * np.finfo(float).eps


def fit(rows: DataFrame) -> Fit | None:
    """Covariance (divisor n) and its components over the integer vectors ``x`` of ``rows``."""
    stats = dimensions(rows)
    if not stats:
        return None
    n, low, high = stats[0][0], [s[2] for s in stats], [s[3] for s in stats]
    moved = [s[1] - n * s[2] for s in stats]
    crosses = scatter(rows, low, [(b - a).bit_length() for a, b in zip(low, high)])
    covariance = np.zeros((len(stats), len(stats)))
    for d in range(len(stats)):
        for e in range(d, len(stats)):  # integers to the end, one rounding
            covariance[d, e] = covariance[e, d] = (n * crosses.get((d, e), 0) - moved[d] * moved[e]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return Fit(n, [s[1] for s in stats], low, high, covariance, values, vectors * signs)


def project(rows: DataFrame, found: Fit, components: int) -> DataFrame:
    """``rows`` with deviation and whitened (array) in place of ``x``.

    deviation, the sum over dimensions of (n * x - S) ** 2, is exact; NULL beyond 38 digits.
    """
    n, mean = found.n, [s // found.n for s in found.sums]
    rest = [s - n * m for s, m in zip(found.sums, mean)]
    k = min(components, len(mean))
    varies = found.varies[:k]
    turn = found.vectors[:, :k] / np.sqrt(np.where(varies, found.values[:k], 1))
    widest = max(n * max(b - m, m - a) + n for a, b, m in zip(found.low, found.high, mean))
    kind = np.int64 if len(mean) * widest * widest < 1 << 63 else object
    through = [c for c in rows.columns if c not in ("x", "deviation", "whitened")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = pa.decimal128(38, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                away = _matrix(part.column(len(through))) - np.array(mean, np.int64)
                whitened = (away - np.array([r / n for r in rest])) @ turn
                square = ((away.astype(kind) * n - np.array(rest, kind)) ** 2).sum(axis=1)
                deviation = (pa.array(square).cast(exact) if kind is np.int64 else
                             pa.array([v if v < 10 ** 38 else None for v in square.tolist()], exact))
                flat = pa.array(whitened.ravel(), mask=np.tile(~varies, len(whitened)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(whitened) + 1, dtype=np.int32) * k), flat)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(through))), deviation, lists], [*through, "deviation", "whitened"])

    kept = rows.select(*through)
    schema = StructType([*kept.schema.fields, StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))])
    return rows.select(*through, "x").mapInArrow(run, schema)


def identity_error(whitened: DataFrame, varies: np.ndarray) -> float:
    """Largest absolute entry of the covariance (of what varies) minus the identity, over all rows."""
    own = [i for i, v in enumerate(varies) if v]
    pairs = [(i, j) for i in own for j in own if i <= j]
    if not pairs:
        return 0.0
    w = F.col("whitened")
    found = whitened.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, found))


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = 8, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per vector that takes part and component from 1 to ``components``: the other
    columns, component, n, deviation, whitened, explained and identity_error."""
    rows = integers(vectors, vector, scale, shift)
    found = fit(rows)
    new = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    others = [c for c in rows.columns if c not in (*new, "x")]
    if found is None:
        return rows.where("false").select(*others, *[F.lit(None).cast(t).alias(c) for c, t in zip(new, ("int", "long", "decimal(38,0)", "double", "double", "double"))])
    done = written(project(rows.select(*others, "x"), found, components))
    k = min(components, len(found.sums))
    error = identity_error(done, found.varies[:k])
    explained = F.array(*[F.lit(float(e)) for e in found.explained[:k]])
    return (done.select(*others, "deviation", F.posexplode("whitened").alias("__at", "whitened"))
            .select(*others, (F.col("__at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(explained, F.col("__at") + 1).alias("explained"), F.lit(error).alias("identity_error")))
