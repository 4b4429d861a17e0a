"""Boosted trees and their attributions against plain loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tidewright.operators import boosting as B

X = ["a", "b", "c"]
CUTS = {"a": [-1.0, -0.5, 0.0, 0.5, 1.0], "b": [-0.7, 0.0, 0.7], "c": [0.0]}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 3))
    x[::50, 1] = np.nan
    y = 2 * (x[:, 0] > 0.2) + np.abs(np.nan_to_num(x[:, 1])) * x[:, 2] + rng.normal(size=900) * (0.3 + (x[:, 0] > 0))
    grade = np.digitize(y, [0.0, 1.5])
    df = spark.createDataFrame([(i, *map(float, v), float(t), int(g)) for i, (v, t, g) in enumerate(zip(x, y, grade))], "id long, a double, b double, c double, y double, g int")
    return x, y, grade, df.withColumn("b", F.when(F.isnan("b"), None).otherwise(F.col("b"))).repartition(4).cache()


def grow(x, g, h, depth, least, l2, node=1, at=None, out=None):
    """The same tree by recursion over index lists: {node: (feature, cut)} and {leaf: rows}."""
    at = np.arange(len(x)) if at is None else at
    out = {} if out is None else out
    best = (1e-9, None)
    if node < 2 ** depth:
        for j, f in enumerate(X):
            for c in CUTS[f]:
                left = ~(x[at, j] > c)
                if min(left.sum(), (~left).sum()) < least:
                    continue
                score = lambda s: g[at][s].sum() ** 2 / (h[at][s].sum() + l2)
                gain = score(left) + score(~left) - score(np.ones(len(at), bool))
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (j, c, left))
    if best[1] is None:
        out[node] = at
        return out
    j, c, left = best[1]
    grow(x, g, h, depth, least, l2, 2 * node, at[left], out)
    grow(x, g, h, depth, least, l2, 2 * node + 1, at[~left], out)
    return out


def test_squared_loss_equals_the_loop(rows):
    x, y, _, df = rows
    forest = B.fit(df, X, "y", rounds=3, depth=3, rate=0.3, min_rows=10, cuts=CUTS, store_every=2)
    f = np.full(len(y), y.mean())
    for _ in range(3):
        for at in grow(x, y - f, np.ones(len(y)), 3, 10, 1.0).values():
            f[at] += 0.3 * (y - f)[at].sum() / (len(at) + 1.0)
    got = {r["id"]: r["p"] for r in B.predict(forest, df, ["p"]).collect()}
    assert np.allclose([got[i] for i in range(len(y))], f)


def test_quantile_leaves_are_quantiles_of_residuals(rows):
    x, y, _, df = rows
    levels = [0.1, 0.5, 0.9]
    forest = B.fit(df, X, "y", "quantile", levels, rounds=2, depth=2, rate=0.5, min_rows=10, cuts=CUTS)
    disc = lambda v, p: np.sort(v)[max(0, math.ceil(p * len(v) - 1e-9) - 1)]
    want = []
    for p in levels:
        f = np.full(len(y), disc(y, p))
        for _ in range(2):
            step = np.zeros(len(y))
            for at in grow(x, np.where(y > f, p, p - 1), np.ones(len(y)), 2, 10, 1.0).values():
                step[at] = 0.5 * disc((y - f)[at], p)
            f = f + step
        want.append(f)
    got = {r["id"]: (r["lo"], r["mid"], r["hi"]) for r in B.predict(forest, df, ["lo", "mid", "hi"]).collect()}
    assert np.allclose([got[i] for i in range(len(y))], np.sort(np.array(want).T, axis=1))
    more = B.fit(df, X, "y", "quantile", [0.9], rounds=12, depth=2, cuts=CUTS)
    loss = lambda f: np.where(y > f, 0.9 * (y - f), 0.1 * (f - y)).mean()
    s = more.scores(x)[:, 0]
    assert loss(s) < 0.85 * loss(np.full(len(y), np.quantile(y, 0.9))) and 0.8 < (y <= s).mean() <= 0.97


def test_softmax_equals_the_loop(rows):
    x, _, grade, df = rows
    forest = B.fit(df, X, "g", "softmax", [0, 1, 2], rounds=2, depth=2, rate=0.4, min_rows=10, cuts=CUTS)
    f = np.log(np.array([(grade == c).mean() for c in range(3)]))[None].repeat(len(grade), axis=0)
    for _ in range(2):
        p = np.exp(f) / np.exp(f).sum(axis=1, keepdims=True)
        step = np.zeros(f.shape)
        for c in range(3):
            g, h = (grade == c) - p[:, c], p[:, c] * (1 - p[:, c])
            for at in grow(x, g, h, 2, 10, 1.0).values():
                step[at, c] = 0.4 * g[at].sum() / (h[at].sum() + 1.0)
        f = f + step
    want = np.exp(f) / np.exp(f).sum(axis=1, keepdims=True)
    out = {r["id"]: r for r in B.predict_class(forest, B.predict(forest, df, ["p0", "p1", "p2"])).collect()}
    assert np.allclose([[out[i][f"p{c}"] for c in range(3)] for i in range(len(grade))], want)
    assert [out[i]["prediction"] for i in range(len(grade))] == want.argmax(axis=1).tolist()


def expected(tree, x, known, node=1):
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    if f in known:
        return expected(tree, x, known, 2 * node + int(x[f] > tree.cut[node]))
    return sum(tree.cover[c] / tree.cover[node] * expected(tree, x, known, c) for c in (2 * node, 2 * node + 1))


def shapley(trees, x, k):
    out = np.zeros(k)
    for i in range(k):
        rest = [j for j in range(k) if j != i]
        for n in range(k):
            for s in itertools.combinations(rest, n):
                w = math.factorial(n) * math.factorial(k - n - 1) / math.factorial(k)
                out[i] += w * sum(expected(t, x, {*s, i}) - expected(t, x, set(s)) for t in trees)
    return out


@pytest.mark.parametrize("kind", ["own", "boosted", "forest"])
def test_attribution_equals_all_subsets(rows, kind):
    x, _, _, df = rows
    if kind == "own":
        forest, some = B.fit(df, X, "y", rounds=3, depth=3, cuts=CUTS), df.filter("id < 60")
    else:
        make = GBTRegressor(featuresCol="v", labelCol="y", maxIter=3, maxDepth=4) if kind == "boosted" else RandomForestRegressor(featuresCol="v", labelCol="y", numTrees=3, maxDepth=3)
        whole = VectorAssembler(inputCols=X, outputCol="v").transform(df.na.drop())
        model = make.fit(whole)
        forest, some = B.from_ml(model, X), df.filter("id < 60 and b is not null")
        told = {r["id"]: r["prediction"] for r in model.transform(whole).filter("id < 60").collect()}
    got = {}
    for r in B.tree_attribution(forest, some, "id").collect():
        got.setdefault(r["id"], {})[r["feature"]] = (r["attribution"], r["yhat"], r["base"])
    scores = forest.scores(x[:60])[:, 0]
    for i, parts in got.items():
        want = shapley([r[0] for r in forest.trees], x[i], 3)
        assert np.allclose([parts[f][0] for f in X], want, atol=1e-9)
        assert np.isclose(parts["a"][1], scores[i]) and np.isclose(parts["a"][2] + want.sum(), scores[i])
        if kind != "own":
            assert np.isclose(told[i], scores[i])


def test_no_rows_and_nothing_to_split(rows):
    *_, df = rows
    assert B.fit(df.filter("id < 0"), X, "y").trees == []
    flat = B.fit(df.withColumn("y", F.lit(2.0)), X, "y", cuts=CUTS)
    assert flat.trees == [] and B.predict(flat, df, ["p"]).select("p").distinct().collect() == [(2.0,)]


def test_blocks_do_not_shrink_with_the_sessions_arrow_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "100")  # as the operators on texts set smaller batches
    try:
        rows = spark.range(12_500).coalesce(1).selectExpr("cast(id % 7 as double) as a", "cast(id % 3 as double) as y")
        sizes = [r["n"] for r in B._blocks(rows, F.col("y"), ["a"], [np.array([1.0, 3.0])], np.zeros(1)).collect()]
    finally:
        spark.conf.set(name, before)
    assert sorted(sizes) == [2500, 10_000]
