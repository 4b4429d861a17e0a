"""Several series together: components, regimes, Granger tests, vector autoregression, cointegration."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.tails import f_sf
from tidewright.operators.assoc import correlation_matrix
from tidewright.operators.clean import standardise
from tidewright.operators.diagnostics import adf
from tidewright.operators.gram import Moments, moment_rows, solve_rows
from tidewright.operators.ordering import attach, lag_of, look_around
from tidewright.session import settle


# ------------------------------------------------------------------ components
def principal_components(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Loadings of standardised columns: (component, feature, loading, explained).

    The correlation matrix is one distributed aggregate; the k × k eigenproblem is solved on its single
    row. Signs are fixed so that the loading of largest size is positive.
    """
    cols = list(cols)
    row = correlation_matrix(df.select(*cols).na.drop(), cols).agg(F.collect_list(F.struct("a", "b", "c")).alias("cells"))

    def solve(batches):
        for pdf in batches:
            for cells in pdf["cells"]:
                m = np.eye(len(cols))
                for c in cells:
                    m[cols.index(c["a"]), cols.index(c["b"])] = c["c"]
                values, vectors = np.linalg.eigh(m)
                order = np.argsort(values)[::-1]
                out = []
                for rank, j in enumerate(order, 1):
                    v = vectors[:, j] * np.sign(vectors[np.argmax(np.abs(vectors[:, j])), j])
                    out += [{"component": rank, "feature": f, "loading": float(x), "explained": float(values[j] / values.sum())}
                            for f, x in zip(cols, v, strict=True)]
                yield pd.DataFrame(out)

    return row.mapInPandas(solve, "component int, feature string, loading double, explained double")


def component_scores(df: DataFrame, cols: Sequence[str], loadings: DataFrame, n_components: int) -> DataFrame:
    """Scores ``pc1 …`` of each row; the k × n loadings (a bounded table) become projection literals."""
    table = {(r["component"], r["feature"]): r["loading"] for r in loadings.filter(F.col("component") <= n_components).collect()}
    z = standardise(df, cols, suffix="__z")
    scores = [sum((F.col(f"{c}__z") * table[(i, c)] for c in cols), F.lit(0.0)).alias(f"pc{i}") for i in range(1, n_components + 1)]
    return z.select(*df.columns, *scores)


# ------------------------------------------------------------------ regimes
#: Lloyd's rounds end when no centre moves farther; rounds of draws for starting centres, and of Lloyd's on what they drew.
MOVE, DRAW_ROUNDS, LOCAL_ROUNDS = 1e-4, 2, 30


@dataclass(frozen=True)
class Centres:
    """A fitted k-means: centres in ascending order of coordinates (fewer than k where there are fewer distinct rows), and the cost of the last round."""

    centres: np.ndarray
    cost: float


def _vectors(column) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an Arrow array<double> column without missing or infinite parts, as a matrix, and which rows those are."""
    whole = pc.is_valid(column).to_numpy(zero_copy_only=False)
    lists = column.filter(pc.is_valid(column))
    width = pc.unique(pc.list_value_length(lists)).to_pylist()
    if len(width) > 1:
        raise ValueError(f"feature arrays of unlike lengths: {sorted(width)}")
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), width[0] if width else 0)
    finite = np.isfinite(x).all(axis=1)
    whole[whole] = finite
    return x[finite], whole


def _stored_vectors(df: DataFrame, features: str) -> DataFrame:
    """(n, x, h): blocks of an Arrow batch of rows, their features and their hashes (of the whole row, for draws) as bytes, so that a pass reads a block at a time.
    Rows with a missing feature are left out."""
    def run(batches):
        for b in batches:
            x, whole = _vectors(b.column("x"))
            if len(x):
                h = b.column("h").to_numpy(zero_copy_only=False)[whole]
                yield pa.RecordBatch.from_pydict({"n": [len(x)], "x": [x.tobytes()], "h": [h.tobytes()]})

    blocks = df.select(F.col(features).cast("array<double>").alias("x"), F.xxhash64(*df.columns).alias("h")).mapInArrow(run, "n long, x binary, h binary")
    return settle(blocks, **{"parquet.block.size": 16 << 20})


def _blocks(batches, hashes: bool = False):
    """The matrices of a task's blocks, and their hashes."""
    for b in batches:
        for i in range(b.num_rows):
            x = np.frombuffer(b.column("x")[i].as_buffer(), dtype=float).reshape(b.column("n")[i].as_py(), -1)
            yield x, np.frombuffer(b.column("h")[i].as_buffer(), dtype=np.int64) if hashes else None


def _turned(x: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows about ``middle`` as columns of a matrix, and their squared lengths."""
    columns = np.ascontiguousarray(x.T) - middle[:, None]
    return columns, (columns ** 2).sum(axis=0)


def _nearest_centre(columns: np.ndarray, length: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre (the first of equals) and the squared distance to it, for rows as in ``_turned`` and centres about the same middle."""
    far = (-2.0 * centres) @ columns
    far += (centres ** 2).sum(axis=1)[:, None]
    best, label = far[0], np.zeros(columns.shape[1], dtype=np.int8 if len(centres) < 128 else np.int32)
    for j in range(1, len(centres)):
        np.copyto(label, j, where=far[j] < best)
        np.minimum(best, far[j], out=best)
    best += length
    return label, np.maximum(best, 0.0, out=best)


def _uniform(h: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Numbers in [0, 1) from hashes, a seed and a step."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53


def _sums(rows: DataFrame, sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each set of centres: sums and counts of the rows nearest to each centre, and all squared distances. One pass for all sets, a row per task and set."""
    middle = np.concatenate(sets).mean(axis=0)

    def run(batches):
        total, cost = [np.zeros((len(c), c.shape[1] + 1)) for c in sets], np.zeros(len(sets))
        for x, _ in _blocks(batches):
            ones, turned = np.column_stack([x, np.ones(len(x))]), _turned(x, middle)
            for s, c in enumerate(sets):
                label, far = _nearest_centre(*turned, c - middle)
                total[s] += (label == np.arange(len(c), dtype=label.dtype)[:, None]).astype(float) @ ones
                cost[s] += far.sum()
        yield pa.RecordBatch.from_pydict({"s": pa.array(range(len(sets)), pa.int32()), "t": pa.array([t.ravel().tolist() for t in total], pa.list_(pa.float64())), "c": cost})

    out = [(np.zeros((len(c), c.shape[1] + 1)), [0.0]) for c in sets]
    for r in rows.select("n", "x").mapInArrow(run, "s int, t array<double>, c double").collect():
        total, cost = out[r["s"]]
        total += np.array(r["t"]).reshape(total.shape)
        cost[0] += r["c"]
    return [(t[:, :-1], t[:, -1], c[0]) for t, c in out]


def _first_rows(rows: DataFrame, seeds: Sequence[int]) -> list[np.ndarray]:
    """A row drawn by hash for each seed; none if there are no rows."""
    def run(batches):
        best: dict = {}
        for x, h in _blocks(batches, hashes=True):
            for s, seed in enumerate(seeds):
                u = _uniform(h, seed, 0)
                i = int(np.argmin(u))
                best[s] = min(best.get(s, (2.0, [])), (float(u[i]), x[i].tolist()))
        yield pa.RecordBatch.from_pydict({"s": pa.array(list(best), pa.int32()), "u": pa.array([u for u, _ in best.values()], pa.float64()),
                                          "x": pa.array([x for _, x in best.values()], pa.list_(pa.float64()))})

    found: dict = {}
    for r in rows.mapInArrow(run, "s int, u double, x array<double>").collect():
        found[r["s"]] = min(found.get(r["s"], (2.0, [])), (r["u"], list(r["x"])))
    return [np.array([found[s][1]]) for s in sorted(found)]


def _drawn(rows: DataFrame, sets: list[np.ndarray], share: list[float], seeds: Sequence[int], step: int) -> list[np.ndarray]:
    """``sets`` with the distinct rows drawn for each, with a probability of ``share`` times the squared distance to it."""
    middle = np.concatenate(sets).mean(axis=0)

    def run(batches):
        for x, h in _blocks(batches, hashes=True):
            turned = _turned(x, middle)
            for s, c in enumerate(sets):
                hit = x[_uniform(h, seeds[s], step) < share[s] * _nearest_centre(*turned, c - middle)[1]]
                if len(hit):
                    hit = np.unique(hit, axis=0)
                    yield pa.RecordBatch.from_pydict({"s": pa.array([s] * len(hit), pa.int32()), "x": pa.array(hit.tolist(), pa.list_(pa.float64()))})

    more = rows.mapInArrow(run, "s int, x array<double>").distinct().collect()
    return [np.unique(np.array([*c.tolist(), *[list(r["x"]) for r in more if r["s"] == s]]), axis=0) for s, c in enumerate(sets)]


def _reduced(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of a few weighted points: drawn far apart, then Lloyd's rounds."""
    if len(points) <= k:
        return points
    rng = np.random.default_rng(seed)
    weight, turned = np.maximum(weight, 1e-9), _turned(points, np.zeros(points.shape[1]))
    centres = points[rng.choice(len(points), 1, p=weight / weight.sum())]
    while len(centres) < k:
        mass = weight * _nearest_centre(*turned, centres)[1]
        mass[(points[:, None] == centres[None]).all(axis=2).any(axis=1)] = 0.0
        if not mass.sum():
            break
        centres = np.concatenate([centres, points[rng.choice(len(points), 1, p=mass / mass.sum())]])
    for _ in range(LOCAL_ROUNDS):
        label = _nearest_centre(*turned, centres)[0]
        moved = np.array([np.average(points[label == j], axis=0, weights=weight[label == j]) if (label == j).any() else centres[j] for j in range(len(centres))])
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def _fits(df: DataFrame, features: str, starts: Sequence[tuple[int, int]], max_iter: int) -> list[Centres]:
    """A k-means for each (k, seed). All start and move in the same passes over rows stored once; a start that has settled takes no part in later ones.

    Starting centres as in k-means||: a row, then two rounds of rows drawn in proportion to their squared distances, weighted by the rows nearest to them.
    Draws are hashes of whole rows, the same for any partitioning.
    """
    rows, ks, seeds = _stored_vectors(df, features), [k for k, _ in starts], [seed for _, seed in starts]
    sets = _first_rows(rows, seeds)
    if not sets:
        return [Centres(np.zeros((0, 0)), 0.0) for _ in starts]
    for step in range(1, DRAW_ROUNDS + 1):
        costs = [cost for _, _, cost in _sums(rows, sets)]
        sets = _drawn(rows, sets, [2.0 * k / c if c > 0 else 0.0 for k, c in zip(ks, costs)], seeds, step)
    sets = [_reduced(c, n, k, seed) for c, (_, n, _), k, seed in zip(sets, _sums(rows, sets), ks, seeds)]
    cost, open_ = [float("inf")] * len(starts), list(range(len(starts)))
    for _ in range(max_iter):
        if not open_:
            break
        for s, (total, n, spent) in zip(list(open_), _sums(rows, [sets[s] for s in open_])):
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1.0)[:, None], sets[s])
            if (((moved - sets[s]) ** 2).sum(axis=1) <= MOVE ** 2).all():
                open_.remove(s)
            sets[s], cost[s] = moved, spent
    return [Centres(c[np.lexsort(c.T[::-1])], v) for c, v in zip(sets, cost)]


def kmeans(df: DataFrame, features: str, k: int, seeds: Sequence[int] = tuple(range(10)), max_iter: int = 30) -> Centres:
    """Best of several k-means starts by training cost; ``features`` is an array column. Rows with a missing feature take no part."""
    return min(_fits(df, features, [(k, seed) for seed in seeds], max_iter), key=lambda m: m.cost)


def assign(df: DataFrame, model: Centres, features: str) -> DataFrame:
    """``df`` with the nearest centre's number as ``cluster``, null for rows with a missing feature."""
    centres = model.centres
    if not len(centres):
        return df.withColumn("cluster", F.lit(None).cast("int"))
    middle = centres.mean(axis=0)

    @F.arrow_udf("int")
    def place(column: pa.Array) -> pa.Array:
        x, whole = _vectors(column)
        out = np.zeros(len(column), dtype=np.int32)
        if len(x):
            out[whole] = _nearest_centre(*_turned(x, middle), centres - middle)[0]
        return pa.array(out, mask=~whole)

    return df.withColumn("cluster", place(F.col(features).cast("array<double>")))


def silhouette_by_k(df: DataFrame, features: str, ks: Sequence[int], seeds: Sequence[int] = tuple(range(10)), max_iter: int = 30) -> DataFrame:
    """Mean silhouette (squared Euclidean) for each number of clusters, over all rows. All numbers are fitted in the same passes."""
    judge = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster")
    fits = _fits(df, features, [(k, seed) for k in ks for seed in seeds], max_iter)
    out = []
    for i, k in enumerate(ks):
        best = min(fits[i * len(seeds):(i + 1) * len(seeds)], key=lambda m: m.cost)
        rows = assign(df, best, features).filter("cluster IS NOT NULL").withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
        out.append((int(k), float(judge.evaluate(rows))))
    return df.sparkSession.createDataFrame(out, "k int, silhouette double")


# ------------------------------------------------------------------ Granger, VAR
def _lagged(wide: DataFrame, pos: str, names: Sequence[str], max_lag: int) -> DataFrame:
    return look_around(wide, [], pos, {f"{n}__{k}": lag_of(n, k) for n in names for k in range(1, max_lag + 1)})


def granger(wide: DataFrame, pos: str, names: Sequence[str], max_lag: int) -> DataFrame:
    """F test of every ordered pair and lag order: (effect, cause, lag, f, p_value).

    All pairs and orders share one aggregate of products; order L uses the rows on which L lags exist.
    """
    names = list(names)
    rows = _lagged(wide, pos, names, max_lag)
    cols = [*names, *[f"{n}__{k}" for n in names for k in range(1, max_lag + 1)]]
    first = rows.agg(F.min(pos).alias("_p0"))
    rows = attach(rows, first).withColumn("_order", F.explode(F.sequence(F.lit(1), F.lit(max_lag))))
    rows = rows.filter(F.col(pos) - F.col("_p0") >= F.col("_order"))

    def solver(m: Moments, row):
        lag, out = int(row["_order"]), []
        for effect in names:
            own = [f"{effect}__{k}" for k in range(1, lag + 1)]
            _, _, ssr_r, _ = m.fit(effect, own)
            for cause in names:
                if cause == effect:
                    continue
                _, _, ssr_u, dof = m.fit(effect, own + [f"{cause}__{k}" for k in range(1, lag + 1)])
                f = (ssr_r - ssr_u) / lag / (ssr_u / dof)
                out.append({"effect": effect, "cause": cause, "lag": lag, "f": float(f), "p_value": f_sf(f, lag, dof)})
        return out

    return solve_rows(moment_rows(rows, ["_order"], cols, few_groups=True), [], cols,
                      "effect string, cause string, lag int, f double, p_value double", solver)


def granger_matrix(table: DataFrame) -> DataFrame:
    """Smallest p-value over lag orders for each ordered pair."""
    return table.groupBy("effect", "cause").agg(F.min("p_value").alias("min_p"))


def var_order(wide: DataFrame, pos: str, names: Sequence[str], max_lag: int) -> DataFrame:
    """AIC and BIC of vector autoregressions of order 1 … max_lag on the common sample."""
    names = list(names)
    cols = [*names, *[f"{n}__{k}" for n in names for k in range(1, max_lag + 1)]]
    rows = _lagged(wide, pos, names, max_lag).na.drop(subset=cols)

    def solver(m: Moments, _):
        out, k = [], len(names)
        for p in range(1, max_lag + 1):
            xs = [f"{n}__{j}" for j in range(1, p + 1) for n in names]
            i, j = [m.index[x] for x in xs], [m.index[n] for n in names]
            sxy = m.cov[np.ix_(i, j)]
            sigma = m.cov[np.ix_(j, j)] - sxy.T @ np.linalg.solve(m.cov[np.ix_(i, i)], sxy)
            ld, free = np.linalg.slogdet(sigma)[1], p * k * k + k
            out.append({"order": p, "aic": float(ld + 2 * free / m.n), "bic": float(ld + math.log(m.n) * free / m.n), "n": m.n})
        return out

    return solve_rows(moment_rows(rows, [], cols), [], cols, "order int, aic double, bic double, n long", solver)


def var_causality(wide: DataFrame, pos: str, names: Sequence[str], order: int) -> DataFrame:
    """For each variable of a VAR: F test that all other variables' lags are absent from its equation."""
    names = list(names)
    cols = [*names, *[f"{n}__{k}" for n in names for k in range(1, order + 1)]]
    rows = _lagged(wide, pos, names, order).na.drop(subset=cols)

    def solver(m: Moments, _):
        out, every = [], [f"{n}__{k}" for n in names for k in range(1, order + 1)]
        for effect in names:
            _, _, ssr_u, dof = m.fit(effect, every)
            _, _, ssr_r, _ = m.fit(effect, [f"{effect}__{k}" for k in range(1, order + 1)])
            q = order * (len(names) - 1)
            f = (ssr_r - ssr_u) / q / (ssr_u / dof)
            out.append({"effect": effect, "f": float(f), "df1": q, "df2": dof, "p_value": f_sf(f, q, dof)})
        return out

    return solve_rows(moment_rows(rows, [], cols), [], cols, "effect string, f double, df1 int, df2 long, p_value double", solver)


# ------------------------------------------------------------------ cointegration
def pair_rows(wide: DataFrame, pos: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Long form of candidate pairs on their common slots: (pair, pos, y, x)."""
    cells = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(f"`{a}`").alias("y"), F.col(f"`{b}`").alias("x")) for a, b in pairs])
    return wide.select(pos, F.inline(cells)).na.drop()


def hedge_ratios(rows: DataFrame, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """Slope and intercept of y on x for each pair."""
    return rows.groupBy(*keys).agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("_a"))


def engle_granger(wide: DataFrame, pos: str, pairs: Sequence[tuple[str, str]], max_lag: int) -> DataFrame:
    """Two-step cointegration of each pair: (pair, beta, coint_stat, coint_p, spread_stat, spread_p)."""
    rows = settle(pair_rows(wide, pos, pairs))
    fit = settle(hedge_ratios(rows))
    spread = settle(attach(rows, fit, ["pair"], max_rows=len(pairs)).select(
        "pair", pos, (F.col("y") - F.col("beta") * F.col("x")).alias("spread"),
        (F.col("y") - F.col("beta") * F.col("x") - F.col("_a")).alias("resid")))
    c = adf(spread, ["pair"], pos, "resid", max_lag, regression="n", n_vars=2)
    s = adf(spread, ["pair"], pos, "spread", max_lag)
    return (fit.select("pair", "beta")
            .join(c.select("pair", F.col("stat").alias("coint_stat"), F.col("p_value").alias("coint_p")), "pair")
            .join(s.select("pair", F.col("stat").alias("spread_stat"), F.col("p_value").alias("spread_p")), "pair")
            .orderBy("coint_p", "pair"))
