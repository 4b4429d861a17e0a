"""Change points against all partitions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import breaks as B


def cost(x, cuts):
    edges = [0, *cuts, len(x)]
    return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(edges, edges[1:]))


def all_cuts(n, k, least):
    for cuts in itertools.combinations(range(1, n), k):
        edges = [0, *cuts, n]
        if all(b - a >= least for a, b in zip(edges, edges[1:])):
            yield cuts


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(6)
    out = {"flat": rng.normal(size=20), "step": np.r_[rng.normal(size=11), rng.normal(size=9) + 4, rng.normal(size=7) - 3],
           "odd": np.r_[rng.normal(size=5) + 2, rng.normal(size=21), rng.normal(size=6) + 1e3], "short": rng.normal(size=3), "one": np.array([5.0])}
    rows = [(k, 10 * i, float(v)) for k, vs in out.items() for i, v in enumerate(vs)] + [("step", 5, None), ("flat", 7, float("nan"))]
    return out, spark.createDataFrame(rows, "s string, p long, v double").repartition(3)


@pytest.mark.parametrize("block,span,least", [(2048, 32, 2), (4, 2, 3), (5, 1, 1)])
def test_fixed_count_is_the_best_of_all(series, monkeypatch, block, span, least):
    known, df = series
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "SPAN", span)
    got = {}
    for r in B.fixed_breaks(df, ["s"], "p", "v", 2, least).collect():
        got.setdefault(r["s"], []).append((r["number"], r["break_pos"] // 10, r["cost"]))
    for name, x in known.items():
        options = list(all_cuts(len(x), 2, least))
        assert (name in got) == bool(options)
        if options:
            want = min(options, key=lambda c: cost(x, c))
            assert [p for _, p, _ in sorted(got[name])] == list(want)
            assert np.isclose(got[name][0][2], cost(x, want), rtol=1e-6)


@pytest.mark.parametrize("least,penalty", [(1, 2.0), (2, 1.0), (4, 3.0), (2, 50.0), (2, None)])
def test_penalised_is_the_best_of_all(series, least, penalty):
    known, df = series
    got = {}
    for r in B.penalised_breaks(df.filter("s <> 'odd'"), ["s"], "p", "v", penalty, min_size=least).collect():
        got.setdefault(r["s"], []).append((r["number"], r["break_pos"] // 10, r["cost"]))
    for name, x in known.items():
        if name == "odd":
            continue
        beta = 3 * x.var() if penalty is None else penalty
        f, way = [0.0 - beta] + [np.inf] * len(x), [[]] + [None] * len(x)
        for t in range(1, len(x) + 1):
            for s in range(0, t - least + 1):
                c = f[s] + cost(x[s:t], []) + beta
                if c < f[t]:
                    f[t], way[t] = c, [*way[s], s] if s else []
        want = way[-1] or []
        assert [p for _, p, _ in sorted(got.get(name, []))] == want
        if want:
            assert np.isclose(got[name][0][2], f[-1])


def test_one_series_without_keys_and_no_rows(series):
    known, df = series
    one = df.filter("s = 'step'").drop("s")
    assert [r["break_pos"] for r in B.fixed_breaks(one, [], "p", "v", 2).orderBy("number").collect()] == [110, 200]
    assert [r["break_pos"] for r in B.penalised_breaks(one, [], "p", "v", 8.0).orderBy("number").collect()] == [110, 200]
    none = df.filter("p < 0")
    assert B.fixed_breaks(none, ["s"], "p", "v", 1).count() == 0 and B.penalised_breaks(none, ["s"], "p", "v").count() == 0


def test_few_starts_stay_open(spark):
    """Where changes come again and again, what stays open is about as long as the way between them."""
    rng = np.random.default_rng(1)
    search = B._Partition(20.0, 2)
    x = np.repeat(rng.permutation(np.arange(100) * 7.0), 40) + rng.normal(size=4000)
    most = 0
    for i, v in enumerate(x):
        search.add(i, float(v))
        most = max(most, len(search.open))
    assert search.breaks() == list(range(40, 4000, 40)) and most < 200
