import numpy as np
import pytest
from pyspark.sql import functions as F

from comarca.llm import vantage_trees


def brute(rows, k=20):
    """rows: id → vector; largest inner products of ids divisible by 20, ties to smaller ids."""
    out = {}
    for q, v in rows.items():
        if q % 20 == 0:
            scored = []
            for i, w in rows.items():
                if i != q and len(w) == len(v):
                    s = 0.0
                    for a, b in zip(v, w):
                        s += a * b
                    scored.append((-s, i))
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def search(frame, **parameters):
    got = {}
    for r in vantage_trees.nearest(frame, F.col("vec_id") % 20 == 0, **parameters).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("shape", [{}, {"shard_rows": 60, "block_rows": 7, "leaf": 8}])
def test_factor_one_is_exact(spark, sf_dir, shape):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r.vec_id: [float(x) for x in r.embedding] for r in frame.collect()}
    assert search(frame, **shape) == brute(rows)


def test_a_larger_factor_prunes_more_and_keeps_recall(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 8)) * 4
    vectors = centers[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 8)) * 0.3
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    true = brute(dict(enumerate(vectors.tolist())))
    recall = {}
    for factor in (1.0, 1.2):
        got = search(frame, factor=factor, shard_rows=1000, leaf=32)
        recall[factor] = np.mean([len({i for i, _ in got[q]} & {i for i, _ in true[q]}) / 20 for q in true])
    assert recall[1.0] == 1.0 and recall[1.2] >= 0.9

    visited = {}
    for factor in (1.0, 3.0):
        tree, seen = vantage_trees.Tree(vectors, 32), []
        inner = tree.distances
        tree.distances = lambda q, rows: seen.append(len(q) * len(rows)) or inner(q, rows)
        tree.search(vectors[:50], 20, factor, 1e-9)
        visited[factor] = sum(seen)
    assert visited[3.0] < visited[1.0] < 50 * 3000


def test_ties_unusable_and_repeated_rows(spark):
    same = [[1.0, 2.0]] * 300
    rows = [(i, v) for i, v in enumerate(same)]
    odd = [(1000, None), (1001, []), (1002, [0.0, 0.0]), (1003, [None, 1.0]), (1004, [float("nan"), 1.0]), (1005, [float("inf"), 1.0]),
           (None, [1.0, 1.0]), (5, [1.0, 2.0]), (2000, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(*r, 9) for r in rows + odd], "vec_id long, embedding array<double>, rank int")
    got = search(frame, shard_rows=50, leaf=4)
    want = brute({**dict(rows), 2000: [1.0, 2.0, 3.0]})
    assert got == {q: w for q, w in want.items() if w}
    assert search(frame.where("false")) == {}
    few = search(frame.where("vec_id in (0, 1, 2, 1002)"))
    assert few == {0: [(1, 5.0), (2, 5.0)]}
