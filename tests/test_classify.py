from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from comarca.operators import classify
from comarca.spec import IndicatorSpec

METHODS = ("jenks", "quantile", "equal", "stddev")


def frame(spark, values):
    return spark.createDataFrame([(f"{i:02d}", v) for i, v in enumerate(values)],
                                 "geo_code string, valor double")


def bounds(df, method, n=5):
    return [(r.desde, r.hasta) for r in
            classify.class_bounds(df, method, n).orderBy("clase").collect()]


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("values", [
    [26.45, 26.45, 27.0, 28.1, 30.0, 31.9, 26.9, 27.7, None],
    list(np.random.default_rng(3).pareto(1.0, 60)), [1.0, 2.0], [-3.0, 0.0, 0.0, 9.0]])
def test_classes_cover_every_value(spark, method, values):
    df = frame(spark, [None if v is None else float(v) for v in values])
    pairs = bounds(df, method)
    real = [v for v in values if v is not None]
    assert 1 <= len(pairs) <= min(5, len(set(real)))
    assert all(hi > lo for lo, hi in pairs)
    assert pairs[0][0] == min(real) and pairs[-1][1] == max(real)
    assert all(a[1] == b[0] for a, b in zip(pairs, pairs[1:]))
    classed = classify.with_class(df, method).collect()
    assert all((r.clase is None) == (r.valor is None) for r in classed)
    for r in classed:
        if r.clase is not None:
            lo, hi = pairs[r.clase - 1]
            assert lo <= r.valor <= hi
    bars = classify.histogram(df, method).orderBy("clase").collect()
    edges = [pairs[0][0]] + [hi for _, hi in pairs]
    assert [r.n for r in bars] == list(np.histogram(real, bins=edges)[0])


@pytest.mark.parametrize("method", METHODS)
def test_degenerate_results(spark, method):
    assert bounds(frame(spark, [4.0, 4.0, None]), method) == [(4.0, 4.0)]
    assert classify.histogram(frame(spark, [4.0, 4.0]), method).count() == 0
    assert bounds(frame(spark, [None, float("nan")]), method) == []
    one = classify.with_class(frame(spark, [4.0, None]), method).orderBy("geo_code").collect()
    assert [r.clase for r in one] == [1, None]


def test_named_limits(spark):
    df = frame(spark, [0.0, 1.0, 2.0, 3.0, 10.0])
    assert bounds(df, "equal") == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]
    assert bounds(df, "quantile", 2) == [(0, 2), (2, 10)]
    sd, mean = np.std([0, 1, 2, 3, 10]), 3.2
    assert bounds(df, "stddev", 3) == [(0, pytest.approx(mean - sd / 2)),
                                       (pytest.approx(mean - sd / 2),
                                        pytest.approx(mean + sd / 2)),
                                       (pytest.approx(mean + sd / 2), 10)]
    with pytest.raises(ValueError):
        classify.class_bounds(df, "natural")


def squares(groups):
    return sum(((g - g.mean()) ** 2).sum() for g in groups)


@pytest.mark.parametrize("seed", range(4))
def test_jenks_is_the_least_squares_cut(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.sort(np.round(rng.gamma(1.0, 10.0, 18), 1))
    distinct = np.unique(values)
    best = min((squares([values[(values > a) & (values <= b)] for a, b in
                         zip((-1,) + cut, cut + (distinct[-1],))]), cut)
               for cut in combinations(distinct[:-1], 3))
    pairs = bounds(frame(spark, [float(v) for v in values]), "jenks", 4)
    cut = [hi for _, hi in pairs[:-1]]
    ours = squares([values[(values > a) & (values <= b)] for a, b in
                    zip([-1] + cut, cut + [distinct[-1]])])
    assert ours == pytest.approx(best[0])


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).lognormal(0, 2, 5000), np.random.default_rng(2).normal(0, 1, 3000),
    np.concatenate([1000 + np.random.default_rng(3).uniform(-1e-6, 1e-6, 3000), [1020.0, 1021.0]]),
    np.concatenate([np.random.default_rng(s).uniform(0, 10.0 ** e, 1500) + 10.0 ** e for s, e in enumerate((-3, 0, 3))]),
    np.tile(np.arange(300.0), 4), np.concatenate([np.arange(-500.0, 0), np.arange(1.0, 501)]),
    np.repeat(np.random.default_rng(4).uniform(0, 1, 40), 30)],
    ids=["lognormal", "normal", "crowded", "three scales", "repeated", "two equal halves", "few"])
def test_jenks_is_one_way_at_every_size(spark, values):
    pairs = bounds(frame(spark, [float(v) for v in values]), "jenks")
    cut = [hi for _, hi in pairs[:-1]]
    v = np.sort(values)
    scale = np.abs(v).max() if np.abs(v).max() > 1e100 else 1.0
    w = v / scale
    ours = squares([w[(v > a) & (v <= b)] for a, b in zip([-np.inf] + cut, cut + [v[-1]])])
    distinct, n = np.unique(w, return_counts=True)
    ends, best = classify._least_squares_limits(distinct, n.astype(float), distinct, np.zeros(len(distinct)), 5)
    assert ours <= best * (1 + 1e-9) + 1e-18


@pytest.mark.parametrize("seed", range(6))
def test_a_bin_that_is_left_whole_holds_no_better_cut(seed):
    """The bound against all cuts between values, for bins of any width."""
    rng = np.random.default_rng(seed)
    v = np.sort(rng.choice([rng.normal(0, 1, 60), rng.gamma(0.3, 5, 60), np.floor(rng.uniform(0, 40, 60))][seed % 3], 60))
    v, n = np.unique(v, return_counts=True)
    for k in (2, 3, 5):
        ends, best = classify._least_squares_limits(v, n.astype(float), v, np.zeros(len(v)), k)
        cuts = np.sort(rng.choice(np.arange(1, len(v)), min(12, len(v) - 1), replace=False))
        groups = np.split(np.arange(len(v)), cuts)
        table = np.array([(v[g[0]], v[g[-1]], n[g].sum(), np.average(v[g], weights=n[g]),
                           (n[g] * (v[g] - np.average(v[g], weights=n[g])) ** 2).sum()) for g in groups])
        left = ~classify._could_be_better(table, k)
        _, restricted = classify._least_squares_limits(table[:, 1], table[:, 2], table[:, 3], table[:, 4], k)
        if restricted > best * (1 + 1e-9) + 1e-12:   # the best cuts lie inside bins that are to be split
            inside = {int(np.searchsorted(cuts, e, "right")) for e in ends if e not in set(cuts.tolist())}
            assert inside and not left[list(inside)].any()


def test_limits_that_are_there_are_not_computed_again(spark):
    df = frame(spark, [float(v) for v in range(40)])
    edges = classify.class_edges(df, "jenks")
    assert classify.class_bounds(df, edges=edges).count() == 5
    assert sum(r.n for r in classify.histogram(df, edges=edges).collect()) == 40
    assert classify.with_class(df, edges=edges).filter("clase IS NULL").count() == 0


def test_shared_classes_use_the_larger_layer(spark):
    df = spark.createDataFrame(
        [("urbana", float(i)) for i in range(11)] + [("rural", 2.0), ("rural", 50.0)],
        "area string, valor double")
    got = {(r.area, r.valor): r.clase
           for r in classify.shared_classes(df, "area", "equal").collect()}
    assert got[("rural", 2.0)] == got[("urbana", 2.0)] == 1
    assert got[("rural", 50.0)] is None and got[("urbana", 10.0)] == 5


def test_ranking_and_frequencies(spark):
    top = classify.ranking(frame(spark, [float(v) for v in range(20)])).collect()
    assert len(top) == 15 and top[0].valor == 19.0 and top[0].barra == 100
    assert classify.ranking(frame(spark, [-5.0, 5.0])).collect()[1].barra == 1
    assert classify.ranking(frame(spark, [0.0])).collect()[0].barra == 1
    modes = spark.createDataFrame([("1",), ("1",), ("2",), (None,)], "valor string")
    labels = spark.createDataFrame([("x", "01", "Sí")],
                                   "variable string, valor string, etiqueta string")
    rows = classify.modal_frequencies(modes, labels).collect()
    assert (rows[0].texto, rows[0].n, rows[0].barra) == ("1 — Sí", 2, 50)
    legend = classify.category_legend(modes, labels).orderBy("codigo").collect()
    assert [(r.codigo, r.texto) for r in legend] == [(0, "1 — Sí"), (1, "2")]


def test_view_depends_on_the_indicator_and_can_be_chosen(spark):
    view = lambda df, view=None, rows=None, **kw: [
        (r.vista, r.quedan_fuera) for r in classify.summary_view(df, IndicatorSpec(**kw), "equal", view=view, rows=rows).collect()]
    few, many = frame(spark, [1.0, 2.0]), frame(spark, [float(i) for i in range(121)])
    mean = dict(measure="mean", variable="x")
    assert view(few, **mean) == [("ranking", 0)] * 2 and view(many, **mean) == [("ranking", 106)] * 15
    assert len(view(many, rows=121, **mean)) == 121
    assert {v for v, _ in view(many, view="histograma", **mean)} == {"histograma"}
    assert {v for v, _ in view(few, level="unidad", **mean)} == {"histograma"}
    assert {v for v, _ in view(few, measure="mode", variable="x")} == {"frecuencias"}
    assert view(many, measure="mode", variable="x", rows=20)[0] == ("frecuencias", 101)
