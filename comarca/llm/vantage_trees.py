"""Nearest neighbours by inner product with a vantage-point tree per shard.

Largest inner product becomes smallest distance: with M the largest norm, every vector gets
one more component sqrt(M^2 - |x|^2), a query a zero, so |q - x|^2 = |q|^2 + M^2 - 2 q.x.

Rows are dealt over shards of about ``shard_rows`` by a hash of their id, the queries over
blocks.  A task holds one shard, builds its tree once and takes the blocks of queries in
turn.  A tree splits at the median distance to a vantage point.  With tau the distance of
the k-th best so far, a side is visited if

    factor * (distance of the query to the side's range) <= tau.

By the triangle inequality a factor of one leaves nothing out: the search is exact.  Above
one it prunes more and may miss.  Scores are taken again on the original vectors, in double
precision, component after component; order is by score, then smaller id.

Each (query, shard) hands on k rows at most, so what is shuffled grows with queries times
shards; nothing is collected or broadcast but one number (M).

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components,
and rows without an id, take no part; vectors of different lengths are compared within
their own length; of repeated ids one row is taken, the smallest vector; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comarca.llm.common import written

FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): one row per id, with a vector of doubles that can be searched."""
    v = F.col("v")
    return (vectors.where("vec_id IS NOT NULL").select("vec_id", F.col(vector).cast("array<double>").alias("v"))
            .where(F.size("v") > 0)
            .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
            .groupBy("vec_id").agg(F.min(v).alias("v")))


class Tree:
    """Vantage-point tree over the rows of a matrix; leaves of at most ``leaf`` rows."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaf = points, leaf
        self.norms = np.einsum("ij,ij->i", points, points)
        self.root = self._build(np.arange(len(points)))

    def distances(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        square = np.einsum("ij,ij->i", queries, queries)[:, None] + self.norms[rows] - 2 * (queries @ self.points[rows].T)
        return np.sqrt(np.maximum(square, 0))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # the row farthest from the middle sees the others at the most different distances
        middle = self.points[rows].mean(axis=0, keepdims=True)
        vantage = rows[np.argmax(self.distances(middle, rows)[0])]
        d = self.distances(self.points[vantage:vantage + 1], rows)[0]
        inner = d <= np.median(d)
        if inner.all():  # equal distances cannot be split
            inner = d < np.median(d)
            if not inner.any():
                return rows
        sides = [(d[part].min(), d[part].max(), self._build(rows[part])) for part in (inner, ~inner)]
        return int(vantage), sides

    def search(self, queries: np.ndarray, k: int, factor: float, slack: float):
        """Per query the k best rows seen and all others as near: lists of row arrays."""
        best = [np.empty(0, np.int64) for _ in queries]
        near = [np.empty(0) for _ in queries]
        tau = np.full(len(queries), np.inf)

        def visit(node, active: np.ndarray):
            if isinstance(node, np.ndarray):
                d = self.distances(queries[active], node)
                for row, q in enumerate(active):
                    hit = d[row] <= tau[q] + slack
                    if hit.any():
                        near[q], best[q] = np.concatenate([near[q], d[row][hit]]), np.concatenate([best[q], node[hit]])
                        if len(near[q]) > k:
                            tau[q] = np.partition(near[q], k - 1)[k - 1]
                            keep = near[q] <= tau[q] + slack
                            near[q], best[q] = near[q][keep], best[q][keep]
                        elif len(near[q]) == k:
                            tau[q] = near[q].max()
                return
            vantage, sides = node
            d = self.distances(queries[active], np.array([vantage]))[:, 0]
            gap = [np.maximum(np.maximum(lo - d, d - hi), 0) for lo, hi, _ in sides]
            first = gap[0] <= gap[1]
            for part, order in ((first, (0, 1)), (~first, (1, 0))):
                for side in order:
                    going = part & (factor * gap[side] <= tau[active] + slack)
                    if going.any():
                        visit(sides[side][2], active[going])

        visit(self.root, np.arange(len(queries)))
        return best


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up component after component."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, vector: str = "embedding",
            shard_rows: int = 8192, block_rows: int = 4096, leaf: int = 512) -> DataFrame:
    """The k nearest rows of each query row: query_id, rank (from 1), vec_id, score."""
    rows = written(usable(vectors, vector))
    size = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m"),
                    F.count(F.when(is_query, 1)).alias("q")).first()
    shards, blocks = max(1, -(-size.n // shard_rows)), max(1, -(-size.q // block_rows))
    largest = size.m or 0.0
    hashed = F.xxhash64("vec_id")
    data = rows.select(F.lit(0).alias("kind"), F.pmod(hashed, F.lit(shards)).alias("shard"), F.lit(-1).cast("long").alias("block"), "vec_id", "v")
    # a stated query set against all rows, in blocks: each shard takes every block in turn
    asked = (rows.where(is_query)
             .select(F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                     F.pmod(hashed, F.lit(blocks)).alias("block"), "vec_id", "v"))
    dealt = data.unionByName(asked).repartition(4 * shards, "shard").sortWithinPartitions("shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            """(shard, block, ids, list of vectors); rows come ordered by shard and block."""
            now, ids, vs = None, [], []
            for batch in batches:
                for shard, block, i, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                    if (shard, block) != now:
                        if ids:
                            yield *now, ids, vs
                        now, ids, vs = (shard, block), [], []
                    ids.append(i)
                    vs.append(v.values.to_numpy(zero_copy_only=False))
            if ids:
                yield *now, ids, vs

        trees, tree_shard = {}, None
        for shard, block, ids, vs in groups():
            lengths = np.array([len(v) for v in vs])
            if shard != tree_shard:
                trees, tree_shard = {}, shard
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                points, own = np.stack([vs[i] for i in at]), np.array(ids)[at]
                if block < 0:
                    rest = np.sqrt(np.maximum(largest - np.einsum("ij,ij->i", points, points), 0))
                    trees[length] = Tree(np.column_stack([points, rest]), leaf), points, own
                elif length in trees:
                    tree, originals, names = trees[length]
                    wide = np.column_stack([points, np.zeros(len(points))])
                    # one more than k, as the query may be among the rows; rounding of squares is covered
                    slack = 1e-6 * (1.0 + np.sqrt(largest) + np.sqrt(np.einsum("ij,ij->i", points, points).max()))
                    hits = tree.search(wide, k + 1, factor, slack)
                    for q, found in enumerate(hits):
                        found = found[names[found] != own[q]]
                        score = inner_products(np.broadcast_to(points[q], (len(found), length)), originals[found])
                        top = np.lexsort([names[found], -score])[:k]
                        if len(top):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(top), own[q])), pa.array(names[found][top]), pa.array(score[top])],
                                ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
