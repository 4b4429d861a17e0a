"""Boosted trees on binned features under squared, pinball or softmax loss, and exact additive attributions of trees.

A round grows a tree for every output (quantile level, class) at once: each level of all of them is one aggregate, a histogram of gradients by (output, node,
feature, bin), which each task sums over its blocks of rows before anything moves. Its size depends on bins and depth, not on rows; the driver picks the splits from it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import settle

#: Entries of an approximate quantile's sketch: ranks are exact below as many rows, and off by at most one in as many beyond.
ACCURACY = 10_000


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order: 1 is the root, 2 i and 2 i + 1 the children of i. ``feature`` is -1 where a node doesn't split; ``value`` counts there."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def places(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; a missing feature goes left."""
        node = np.ones(len(x), dtype=np.int64)
        row = np.arange(len(x))
        for _ in range(int(math.log2(len(self.feature)))):
            f = self.feature[node]
            inner = f >= 0
            right = x[row, np.maximum(f, 0)] > self.cut[node]
            node = np.where(inner, 2 * node + right, node)
        return node


@dataclass(frozen=True)
class Forest:
    """The sum of ``base`` and one tree per round for each output."""

    features: list[str]
    outputs: list
    base: np.ndarray
    trees: list[list[Tree]]  # by round, by output
    loss: str = "squared"

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.repeat(self.base[None, :], len(x), axis=0)
        for r in self.trees:
            for k, t in enumerate(r):
                out[:, k] += t.value[t.places(x)]
        return out

    def nodes(self, spark) -> DataFrame:
        """One row per node that rows reached: (round, output, node, feature, cut, value, cover)."""
        rows = []
        for n, r in enumerate(self.trees):
            for k, t in enumerate(r):
                for i in np.flatnonzero(t.cover > 0):
                    inner = t.feature[i] >= 0
                    rows.append((n + 1, str(self.outputs[k]), int(i), self.features[t.feature[i]] if inner else None, float(t.cut[i]) if inner else None,
                                 None if inner else float(t.value[i]), int(t.cover[i])))
        return spark.createDataFrame(rows, "round int, output string, node int, feature string, cut double, value double, cover long")


#: Row groups of stored blocks, so that a task holds few of them at a time.
_STORED = {"parquet.block.size": 16 << 20}
#: Rows of a block, unless a batch has more by itself.
_ROWS = 10_000


def _gathered(batches):
    """Batches put together to blocks, so that a session's small Arrow batches don't make small blocks."""
    held, n = [], 0
    for t in batches:
        if held and n + t.num_rows > _ROWS:
            yield pa.concat_batches(held)
            held, n = [], 0
        held.append(t)
        n += t.num_rows
    if held:
        yield pa.concat_batches(held)


def _blocks(rows: DataFrame, y: Column, features: Sequence[str], edges: list[np.ndarray], base: np.ndarray) -> DataFrame:
    """(n, y, b, f): a block of rows as bytes: labels, bins (a row of the matrix per feature; a missing value lies below all cuts) and scores (one per output)."""
    kind = np.int16 if max(len(e) for e in edges) < 2 ** 15 else np.int32

    def run(batches):
        for t in _gathered(batches):
            if t.num_rows:
                x = [t.column(f"x{j}").to_numpy(zero_copy_only=False) for j in range(len(edges))]
                b = np.stack([np.searchsorted(e, np.where(np.isnan(v), -np.inf, v)) for e, v in zip(edges, x)]).astype(kind)
                f = np.repeat(base[:, None], t.num_rows, axis=1)
                yield pa.RecordBatch.from_pydict({"n": [t.num_rows], "y": [t.column("y").to_numpy(zero_copy_only=False).tobytes()], "b": [b.tobytes()], "f": [f.tobytes()]})

    cols = [F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)]
    return settle(rows.select(y.alias("y"), *cols).mapInArrow(run, "n long, y binary, b binary, f binary"), **_STORED)


def _places(splits: Mapping[int, tuple[int, int]], b: np.ndarray) -> np.ndarray:
    """The node that the splits found so far lead each row's bins to."""
    place = np.ones(b.shape[1], dtype=np.int32)
    todo = [(1, None)]
    while todo:
        node, here = todo.pop()
        if node in splits:
            j, c = splits[node]
            right = b[j] > c
            todo += [(2 * node, ~right if here is None else here & ~right), (2 * node + 1, right if here is None else here & right)]
        elif here is not None:
            np.copyto(place, node, where=here)
    return place


def _open(batches, n_features: int, fresh: list):
    """The labels, bins and scores of a task's blocks; ``fresh`` holds the splits and leaf values of rounds not stored in the scores yet."""
    for t in batches:
        for i in range(t.num_rows):
            n, raw = t.column("n")[i].as_py(), t.column("b")[i].as_buffer()
            b = np.frombuffer(raw, dtype=np.int16 if raw.size == 2 * n * n_features else np.int32).reshape(n_features, n)
            f = np.frombuffer(t.column("f")[i].as_buffer(), dtype=float).reshape(-1, n).copy()
            for splits, value in fresh:
                for k, found in enumerate(splits):
                    f[k] += value[k][_places(found, b)]
            yield np.frombuffer(t.column("y")[i].as_buffer(), dtype=float), b, f


def _gradients(loss: str, outputs: Sequence, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative gradients and curvatures of each output and row."""
    if loss == "quantile":
        return np.stack([np.where(y > v, float(p), float(p) - 1) for p, v in zip(outputs, f)]), np.ones_like(f)
    if loss == "softmax":
        p = np.exp(f - f.max(axis=0))
        p /= p.sum(axis=0)
        return np.stack([(y == float(c)).astype(float) for c in outputs]) - p, np.maximum(p * (1.0 - p), 1e-9)
    return y - f, np.ones_like(f)


def _histograms(state: DataFrame, loss: str, outputs: Sequence, edges: list[np.ndarray], fresh: list, splits: list[dict], level: int) -> DataFrame:
    """(k, node, j, bin, g, h, n) for the open nodes of a level: summed within each task, so that only bins move."""
    wide, low = max(len(e) for e in edges) + 1, 2 ** level
    shape = (len(outputs), len(edges), low, wide)

    def run(batches):
        total = np.zeros((3, *shape))
        for y, b, f in _open(batches, len(edges), fresh):
            g, h = _gradients(loss, outputs, y, f)
            for k in range(len(outputs)):
                place = _places(splits[k], b) - low
                live = place >= 0
                every = live.all()
                own = [v if every else v[live] for v in (place.astype(np.int64) * wide, g[k], h[k])]
                for j in range(len(edges)):
                    cell = own[0] + (b[j] if every else b[j][live])
                    for i, weights in enumerate((own[1], own[2], None)):
                        total[i, k, j] += np.bincount(cell, weights, low * wide).reshape(low, wide)
        at = np.nonzero(total[2])
        ints = {n: pa.array(v, pa.int32()) for n, v in zip(("k", "node", "j", "bin"), (at[0], at[2] + low, at[1], at[3]))}
        yield pa.RecordBatch.from_pydict({**ints, "g": total[0][at], "h": total[1][at], "n": total[2][at].astype(np.int64)})

    cells = state.mapInArrow(run, "k int, node int, j int, bin int, g double, h double, n long")
    return cells.groupBy("k", "node", "j", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def _residuals(state: DataFrame, n_features: int, fresh: list, splits: list[dict]) -> DataFrame:
    """(k, node, r): every row's residual in its leaf, for each output."""
    def run(batches):
        for y, b, f in _open(batches, n_features, fresh):
            for k, found in enumerate(splits):
                yield pa.RecordBatch.from_pydict({"k": np.full(len(y), k, dtype=np.int32), "node": _places(found, b), "r": y - f[k]})

    return state.mapInArrow(run, "k int, node int, r double")


def _restored(state: DataFrame, n_features: int, fresh: list) -> DataFrame:
    """The blocks with the scores of all rounds so far."""
    def run(batches):
        for y, b, f in _open(batches, n_features, fresh):
            yield pa.RecordBatch.from_pydict({"n": [len(y)], "y": [y.tobytes()], "b": [b.tobytes()], "f": [f.tobytes()]})

    return settle(state.mapInArrow(run, "n long, y binary, b binary, f binary"), **_STORED)


def fit(df: DataFrame, features: Sequence[str], label: str, loss: str = "squared", outputs: Sequence = (0,), rounds: int = 20, depth: int = 3, rate: float = 0.1,
        n_bins: int = 32, min_rows: int = 20, l2: float = 1.0, cuts: Mapping[str, Sequence[float]] | None = None, store_every: int = 4) -> Forest:
    """Boost ``rounds`` trees of ``depth`` per output. ``outputs``: levels for ``quantile``, classes for ``softmax``, anything single for ``squared``.

    Leaves have at least ``min_rows`` rows. Under the pinball loss trees are grown on the signs of residuals and each leaf takes the quantile of its rows' residuals,
    one more aggregate a round; under the others a leaf is the Newton step. ``cuts`` are the thresholds tried for a feature, by default its quantiles.
    Rows without a label are left out; a missing feature lies below all cuts. Ties between splits go to the first feature and the smallest cut. No rows: no trees.
    """
    features, outputs, k_all = list(features), list(outputs), len(outputs)
    rows = df.filter(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    found = dict(zip(features, rows.approxQuantile(features, [i / n_bins for i in range(1, n_bins)], 0.001))) if cuts is None else dict(cuts)
    edges = [np.unique(np.array(list(found.get(f) or []), dtype=float)) for f in features]
    y = F.col(label).cast("double")
    if loss == "quantile":
        start = rows.agg(F.percentile_approx(y, [float(p) for p in outputs], ACCURACY).alias("q"), F.count("*").alias("n")).first()
        base = start["q"]
    elif loss == "softmax":
        start = rows.agg(F.array(*[F.avg((y == float(c)).cast("double")) for c in outputs]).alias("q"), F.count("*").alias("n")).first()
        base = [math.log(max(p, 1e-12)) for p in start["q"]] if start["n"] else None
    else:
        start = rows.agg(F.array(F.avg(y)).alias("q"), F.count("*").alias("n")).first()
        base = start["q"]
    if not start["n"]:
        return Forest(features, outputs, np.zeros(k_all), [], loss)
    base = np.array(base, dtype=float)
    state, fresh = _blocks(rows, y, features, edges, base), []
    trees: list[list[Tree]] = []
    width = 2 ** (depth + 1)
    for number in range(rounds):
        splits: list[dict] = [{} for _ in outputs]
        value, cover, gain_at = (np.zeros((k_all, width)) for _ in range(3))
        cut = np.zeros((k_all, width))
        for level in range(depth):
            cells = _histograms(state, loss, outputs, edges, fresh, splits, level).collect()
            table: dict = {}
            for c in cells:
                part = table.setdefault((c["k"], c["node"]), [np.zeros((3, len(e) + 1)) for e in edges])
                part[c["j"]][:, c["bin"]] = c["g"], c["h"], c["n"]
            for (k, node), part in table.items():
                total = part[0].sum(axis=1)
                cover[k, node], value[k, node] = total[2], total[0] / (total[1] + l2)
                best = (1e-9, None)
                for j, hist in enumerate(part):
                    left = np.cumsum(hist, axis=1)[:, :-1]
                    right = total[:, None] - left
                    ok = (left[2] >= min_rows) & (right[2] >= min_rows)
                    if not ok.any():
                        continue
                    gain = np.where(ok, left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - total[0] ** 2 / (total[1] + l2), -np.inf)
                    c = int(np.argmax(gain))
                    if gain[c] > best[0] * (1 + 1e-9):
                        best = (float(gain[c]), (j, c, left[:, c], right[:, c]))
                if best[1]:
                    j, c, left, right = best[1]
                    splits[k][node] = (j, c)
                    cut[k, node], gain_at[k, node] = edges[j][c], best[0]
                    for child, side in ((2 * node, left), (2 * node + 1, right)):
                        cover[k, child], value[k, child] = side[2], side[0] / (side[1] + l2)
        if not any(splits):
            break
        if loss == "quantile":
            leaves = _residuals(state, len(edges), fresh, splits).groupBy("k", "node").agg(F.percentile_approx("r", [float(p) for p in outputs], ACCURACY).alias("q"))
            for r in leaves.collect():
                value[r["k"], r["node"]] = r["q"][r["k"]]
        value *= rate
        feature = np.full((k_all, width), -1)
        for k in range(k_all):
            for node, (j, _) in splits[k].items():
                feature[k, node] = j
        trees.append([Tree(feature[k], cut[k], value[k], cover[k]) for k in range(k_all)])
        fresh.append((splits, value))
        if (number + 1) % store_every == 0 and number + 1 < rounds:
            state, fresh = _restored(state, len(edges), fresh), []
    return Forest(features, outputs, base, trees, loss)


def predict(forest: Forest, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with one column per output: values, quantiles (sorted, so that they never cross) or class probabilities."""
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        s = forest.scores(np.array(x.tolist(), dtype=float).reshape(len(x), len(forest.features)))
        if forest.loss == "quantile":
            s[:, np.argsort(forest.outputs)] = np.sort(s, axis=1)
        elif forest.loss == "softmax":
            s = np.exp(s - s.max(axis=1, keepdims=True))
            s /= s.sum(axis=1, keepdims=True)
        return pd.Series(list(s))

    out = df.withColumn("_scores", run(F.array(*[F.col(f).cast("double") for f in forest.features])))
    return out.withColumns({n: F.col("_scores")[k] for k, n in enumerate(names)}).drop("_scores")


def predict_class(forest: Forest, df: DataFrame, out: str = "prediction") -> DataFrame:
    """The most probable class of each row (the first of equals)."""
    names = [f"_p{k}" for k in range(len(forest.outputs))]
    rows = predict(forest, df, names)
    best = F.array_max(F.array(*[F.struct(F.col(n).alias("p"), F.lit(-k).alias("k")) for k, n in enumerate(names)]))
    labels = F.array(*[F.lit(c) for c in forest.outputs])
    return rows.withColumn(out, F.element_at(labels, 1 - best["k"])).drop(*names)


# ------------------------------------------------------------------ attribution
def from_ml(model, features: Sequence[str]) -> Forest:
    """The trees of a fitted ``pyspark.ml`` regression model (a tree, a forest or boosted trees with numeric features)."""
    trees = list(getattr(model, "trees", [model]))
    weights = list(getattr(model, "treeWeights", [1.0]))
    if type(model).__name__.startswith("RandomForest"):
        weights = [1.0 / len(trees)] * len(trees)
    out = []
    for tree, weight in zip(trees, weights):
        width = 2 ** (tree.depth + 1)
        feature, cut, value, cover = np.full(width, -1), np.zeros(width), np.zeros(width), np.zeros(width)
        todo = [(1, tree._java_obj.rootNode())]
        while todo:
            i, node = todo.pop()
            cover[i], value[i] = node.impurityStats().count(), node.prediction() * weight
            if node.subtreeDepth():
                feature[i], cut[i] = node.split().featureIndex(), node.split().threshold()
                todo += [(2 * i, node.leftChild()), (2 * i + 1, node.rightChild())]
        out.append([Tree(feature, cut, value, cover)])
    return Forest(list(features), [0], np.zeros(1), out)


@dataclass(frozen=True)
class _Leaf:
    """Conditions by feature (feature, above, up to) and, for every pattern of those that a row meets, what the leaf adds to each feature."""

    conditions: list[tuple[int, float, float]]
    shares: np.ndarray


def _leaves(tree: Tree) -> tuple[list[_Leaf], float]:
    """The leaves of a tree for attribution, and the tree's mean over its training rows."""
    out, mean = [], 0.0
    todo = [(1, {}, {})]
    while todo:
        i, bounds, share = todo.pop()
        f = int(tree.feature[i])
        if f >= 0:
            lo, hi = bounds.get(f, (-np.inf, np.inf))
            for child, part in ((2 * i, (lo, min(hi, tree.cut[i]))), (2 * i + 1, (max(lo, tree.cut[i]), hi))):
                todo.append((child, {**bounds, f: part}, {**share, f: share.get(f, 1.0) * tree.cover[child] / tree.cover[i]}))
            continue
        own, m, v = list(bounds), len(bounds), float(tree.value[i])
        z = np.array([share[f] for f in own])
        mean += v * float(np.prod(z))
        if not m or not v:
            continue
        shares = np.zeros((2 ** m, m))
        for code in range(2 ** m):
            o = np.array([code >> a & 1 for a in range(m)], dtype=float)
            for a in range(m):
                rest = [c for c in range(m) if c != a]
                total = 0.0
                for n in range(m):
                    weight = math.factorial(n) * math.factorial(m - n - 1) / math.factorial(m)
                    for known in itertools.combinations(rest, n):
                        total += weight * float(np.prod([o[c] if c in known else z[c] for c in rest]))
                shares[code, a] = v * (o[a] - z[a]) * total
        out.append(_Leaf([(f, *bounds[f]) for f in own], shares))
    return out, mean


def tree_attribution(forest: Forest, df: DataFrame, key: str, output: int = 0) -> DataFrame:
    """Exact Shapley values of a forest, with features a row doesn't know averaged by the training rows on each side of a split:
    (key, feature, value, attribution, yhat, base).

    What a leaf adds to a feature depends only on which of its path's conditions a row meets, so a leaf is a small table (2^m rows for m features on
    its path), made once; rows are scored in one pass, without a shuffle. Attributions of a row add up to ``yhat`` - ``base``. A missing feature goes left.
    """
    made = [_leaves(r[output]) for r in forest.trees]
    base = float(forest.base[output]) + sum(mean for _, mean in made)
    leaves = [leaf for part, _ in made for leaf in part]
    features = list(forest.features)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), dtype=float).reshape(len(x), len(features))
        low = np.where(np.isnan(m), -np.inf, m)
        out = np.zeros(m.shape)
        for leaf in leaves:
            code = np.zeros(len(m), dtype=np.int64)
            for a, (f, above, upto) in enumerate(leaf.conditions):
                code += (((low[:, f] > above) | np.isneginf(above)) & (low[:, f] <= upto)).astype(np.int64) << a
            out[:, [f for f, _, _ in leaf.conditions]] += leaf.shares[code]
        return pd.Series(list(out))

    rows = df.select(key, *features).withColumn("_a", run(F.array(*[F.col(f).cast("double") for f in features])))
    total = F.aggregate("_a", F.lit(base), lambda s, v: s + v)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.col("_a")[i].alias("attribution")) for i, f in enumerate(features)])
    return rows.select(key, total.alias("yhat"), F.lit(base).alias("base"), F.inline(cells)).select(key, "feature", "value", "attribution", "yhat", "base")
