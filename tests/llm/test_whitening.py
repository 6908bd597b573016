import math
import random

import numpy as np
import pytest

from comarca.llm import whitening
from comarca.llm.queries import op12_bit_sliced_whitening


def expected(vectors):
    """x, exact deviations, covariance by integers of any length."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    moved = [[n * a - s for a, s in zip(r, sums)] for r in x]
    d = len(sums)
    cov = np.array([[sum(r[i] * r[j] for r in moved) / n ** 3 for j in range(d)] for i in range(d)])
    return np.array([[a - s / n for a, s in zip(r, sums)] for r in x]), deviation, cov


def check(got, vectors, components=8):
    """``got`` rows (key, component, ...) against numpy, sign aside."""
    away, deviation, cov = expected(list(vectors.values()))
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, len(values))
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(rows) == k * len(vectors)
    for c in range(k):
        assert abs(rows[next(iter(vectors)), c + 1].explained - values[c] / np.trace(cov)) <= 1e-4 * values[c] / np.trace(cov) + 1e-15
        w = np.array([rows[v, c + 1].whitened for v in vectors])
        assert abs(w @ w / len(w) - 1) < 1e-4
        want = away @ axes[:, c] / math.sqrt(values[c])
        assert np.abs(w - want * np.sign(w @ want)).max() < 1e-6 * max(1, np.abs(want).max())
    for (v, _), d in zip(vectors.items(), deviation):
        assert int(rows[v, 1].deviation) == d and rows[v, 1].n == len(vectors)
    assert all(0 <= r.identity_error <= 1e-4 for r in got) and len({r.identity_error for r in got}) == 1


def test_query_against_numpy(spark, sf_dir):
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    vectors = {k: v for k, v in table.items() if v and all(c is not None and math.isfinite(c) for c in v)}
    check(op12_bit_sliced_whitening(spark, sf_dir).collect(), vectors)


@pytest.mark.parametrize("block", [64, 128, 1 << 14])
@pytest.mark.parametrize("d, size, scale", [(1, 1.0, 40), (3, 1.0, 70), (5, 2.0 ** 36, 300), (4, 1e-3, 200), (9, 1000.0, 130)])
def test_whole_numbers_of_any_size(spark, d, size, scale, block, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", block)
    rng = random.Random(d)
    vectors = {i: [rng.gauss(0, size * (j + 1)) for j in range(d)] for i in range(scale)}
    if size < 1:
        vectors = {i: [round(c * 1024 * 4) / 64 for c in v] for i, v in vectors.items()}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(3)
    check(whitening.whiten(df).collect(), vectors)


def test_cross_products_of_planes():
    rng = np.random.default_rng(1)
    for bits in ([3, 0, 17, 5], [0, 0], [40, 1, 30]):
        y = np.array([[int(rng.integers(0, 1 << b)) for b in bits] for _ in range(131)])
        want = [[sum(int(r[i]) * int(r[j]) for r in y) if i <= j else 0 for j in range(len(bits))] for i in range(len(bits))]
        assert whitening.cross_products(y, bits).tolist() == want


def test_what_takes_no_part_and_degenerate_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = {1: [0.5, 1.0], 2: [1.5, -1.0], 3: [2.5, 4.0], 4: [-2.0, 0.25]}
    rows = [*good.items(), (5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0]), (10, []), (11, [1e300, 0.0])]
    df = spark.createDataFrame([(a, b, a, "x") for a, b in rows], "vec_id long, embedding array<double>, component long, whitened string")
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), good)
    assert whitening.whiten(df.where("false")).count() == 0 and whitening.whiten(df.where("false")).columns == out.columns
    equal = spark.createDataFrame([(None, [1.0, 2.0, 3.0])] * 4, "vec_id long, embedding array<float>")
    got = whitening.whiten(equal).collect()
    assert len(got) == 12 and {(r.vec_id, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in got} == {(None, None, 0.0, 0.0, 0)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(50)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got) and got[0].identity_error < 1e-9
    far = spark.createDataFrame([(0, [-(2.0 ** 41)] * 40), (1, [2.0 ** 41] * 40)] * 3, "vec_id long, embedding array<double>")
    assert {int(r.deviation) for r in whitening.whiten(far).collect()} == {40 * (6 * 2 ** 51) ** 2}
