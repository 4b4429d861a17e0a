"""Least squares from moments: one distributed aggregate, then k × k solves on one row per group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


WIDE = 120  # column pairs beyond which an aggregate expression per pair no longer compiles well


def _wide_moment_rows(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Moments through per-batch product matrices of columns shifted by their overall means.

    Each batch yields one row per key and matrix element; sums are combined before the shuffle. A null
    counts as the mean, for callers that ignore the affected elements.
    """
    shift = [0.0 if v is None else float(v) for v in df.agg(*[F.avg(f"`{c}`") for c in cols]).first()]
    k = len(cols)
    upper = np.triu_indices(k)
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys]

    def products(batches):
        held: dict = {}
        for pdf in batches:
            parts = pdf.groupby(keys[0], dropna=False) if keys else [(None, pdf)]
            for key, part in parts:
                x = np.nan_to_num(part[cols].to_numpy(dtype=float) - np.asarray(shift))
                n, s, p = held.get(key, (0, np.zeros(k), np.zeros((k, k))))
                held[key] = (n + len(x), s + x.sum(axis=0), p + x.T @ x)
        for key, (n, s, p) in held.items():
            flat = np.concatenate([[float(n)], s, p[upper]])
            out = pd.DataFrame({"i": np.arange(len(flat)), "v": flat})
            if keys:
                out.insert(0, keys[0], key)
            yield out

    cells = df.select(*keys, *cols).mapInPandas(products, ", ".join([*fields, "i int", "v double"]))
    sums = cells.groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    row = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))  # fixed length
    flat, n = F.col("c.v"), F.element_at("c.v", 1)
    means = F.transform(F.slice(flat, 2, k), lambda v: v / n)
    pairs = F.array(*[F.struct(F.lit(int(a)).alias("a"), F.lit(int(b)).alias("b")) for a, b in zip(*upper, strict=True)])
    covs = F.transform(F.arrays_zip(F.slice(flat, 2 + k, len(upper[0])).alias("p"), pairs.alias("ij")),
                       lambda z: z["p"] / n - means[z["ij"]["a"]] * means[z["ij"]["b"]])
    back = F.transform(F.arrays_zip(means.alias("m"), F.array(*[F.lit(v) for v in shift]).alias("s")), lambda z: z["m"] + z["s"])
    return row.select(*keys, n.cast("long").alias("n"), back.alias("means"), covs.alias("covs"))


def moment_rows(df: DataFrame, keys: Sequence[str], cols: Sequence[str], few_groups: bool = False) -> DataFrame:
    """n, means and the upper triangle of population covariances of ``cols``, one row per group.

    Covariances are merged from centred partial sums, so large levels lose no precision. Wide sets of
    columns without keys (or with ``few_groups`` of one key) take the matrix path: one product matrix per
    task, summed by Spark.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    if len(pairs) > WIDE and (not keys or (few_groups and len(keys) == 1)):
        return _wide_moment_rows(df, list(keys), list(cols))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array(*[F.avg(f"`{c}`") for c in cols]).alias("means"),
        F.array(*[F.covar_pop(f"`{a}`", f"`{b}`") for a, b in pairs]).alias("covs"))


class Moments:
    """One group's moments as matrices; ``fit`` solves a regression between named columns."""

    def __init__(self, cols: Sequence[str], n: int, means, covs):
        self.index = {c: i for i, c in enumerate(cols)}
        self.n, k = int(n), len(cols)
        self.mean = np.asarray(means, dtype=float)
        self.cov = np.zeros((k, k))
        upper = np.triu_indices(k)
        values = np.array([np.nan if v is None else v for v in covs], dtype=float)
        self.cov[upper] = values
        self.cov.T[upper] = values

    def fit(self, y: str, xs: Sequence[str], intercept: bool = True):
        """Coefficients, their standard errors, residual sum of squares and degrees of freedom."""
        j, i = self.index[y], [self.index[x] for x in xs]
        m = self.cov if intercept else self.cov + np.outer(self.mean, self.mean)
        sxx, sxy, syy = m[np.ix_(i, i)], m[i, j], m[j, j]
        dof = self.n - len(xs) - int(intercept)
        if not xs:
            return np.zeros(0), np.zeros(0), self.n * syy, dof
        inv = np.linalg.pinv(sxx) if np.linalg.matrix_rank(sxx) < len(xs) else np.linalg.inv(sxx)
        beta = inv @ sxy
        ssr = max(0.0, self.n * (syy - sxy @ beta))
        se = np.sqrt(np.maximum(0.0, ssr / dof * np.diag(inv) / self.n)) if dof > 0 else np.full(len(xs), np.nan)
        return beta, se, ssr, dof

    def intercept(self, y: str, xs: Sequence[str], beta) -> float:
        return float(self.mean[self.index[y]] - sum(b * self.mean[self.index[x]] for b, x in zip(beta, xs, strict=True)))


def solve_rows(moments: DataFrame, keys: Sequence[str], cols: Sequence[str], schema: str,
               solver: Callable[[Moments, dict], list[dict]]) -> DataFrame:
    """Apply ``solver`` to each moment row; it returns result rows as dictionaries (keys are added)."""
    cols, keys, extra = list(cols), list(keys), [c for c in moments.columns if c not in ("n", "means", "covs")]
    fields = [f"`{k}` {moments.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                m = Moments(cols, row["n"], row["means"], row["covs"])
                out += [{**{k: row[k] for k in keys}, **res} for res in solver(m, {k: row[k] for k in extra})]
            if out:
                yield pd.DataFrame(out)

    return moments.mapInPandas(run, ", ".join([*fields, schema]))


def regress(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """OLS with intercept for each group: (keys, term, coef, se, r2, n)."""
    cols, xs = [y, *xs], list(xs)

    def solver(m: Moments, _):
        beta, se, ssr, _dof = m.fit(y, xs)
        total = m.n * m.cov[0, 0]
        r2 = 1 - ssr / total if total > 0 else float("nan")
        rows = [{"term": "intercept", "coef": m.intercept(y, xs, beta), "se": float("nan"), "r2": r2, "n": m.n}]
        return rows + [{"term": x, "coef": float(b), "se": float(s), "r2": r2, "n": m.n} for x, b, s in zip(xs, beta, se, strict=True)]

    return solve_rows(moment_rows(df.na.drop(subset=cols), keys, cols), keys, cols,
                      "term string, coef double, se double, r2 double, n long", solver)
