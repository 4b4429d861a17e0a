"""Forecast models for panels: smoothing, autoregression, harmonic regression, trees, recursion, backtests."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.gram import Moments, moment_rows, regress, solve_rows
from tidewright.operators.ordering import attach, lag_of, look_around
from tidewright.operators.recursion import score_grid
from tidewright.session import settle


# ------------------------------------------------------------------ exponential smoothing
def _system(kind: str, m: int):
    """State transition, input vector and forecast vector of a smoothing recursion in error form."""

    def ses(p):
        a = p["level"]
        return np.array([[1 - a]]), np.array([a]), np.array([1.0])

    def holt(p):
        a, c = p["level"], p["level"] * p["trend"]
        return np.array([[1 - a, 1 - a], [-c, 1 - c]]), np.array([a, c]), np.array([1.0, 1.0])

    def seasonal(p):
        a, c, g = p["level"], p["level"] * p["trend"], p["season"]
        t = np.zeros((m + 2, m + 2))
        forecast = np.zeros(m + 2)
        forecast[[0, 1, m + 1]] = 1.0
        t[0, :2] = 1.0
        t[1, 1] = 1.0
        t[2, m + 1] = 1.0
        for i in range(3, m + 2):
            t[i, i - 1] = 1.0
        gain = np.zeros(m + 2)
        gain[:3] = a, c, g
        return t - np.outer(gain, forecast), gain, forecast

    return {"ses": ses, "holt": holt, "holt_winters": seasonal}[kind]


SMOOTHING_GRID = {
    "ses": [{"level": a} for a in (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)],
    "holt": [{"level": a, "trend": b} for a in (0.1, 0.3, 0.5, 0.8) for b in (0.01, 0.05, 0.1, 0.3)],
    "holt_winters": [{"level": a, "trend": b, "season": g} for a in (0.05, 0.2, 0.5) for b in (0.001, 0.05) for g in (0.05, 0.2)],
}


def smoothing_forecast(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, kind: str, horizon: int, m: int = 1,
                       grid: Sequence[dict] | None = None) -> DataFrame:
    """Exponential smoothing of a panel: (series, step, pos, yhat, sse, level, trend, season).

    Every parameter set is scored over block-wise recursions and Spark keeps the smallest squared error.
    First states come from the first two seasons (a bounded number of rows per series).
    """
    keys, params = list(series_cols), list(grid or SMOOTHING_GRID[kind])
    system = _system(kind, m)
    head = max(2 * m, 2)
    ends = df.groupBy(*keys).agg(F.min(pos).alias("_p0"))
    first = attach(df.select(*keys, pos, value), ends, keys).filter(F.col(pos) - F.col("_p0") < head)
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("y")))).alias("_h"))
    y = F.col("_h.y")

    def mean(a):
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)

    if kind == "ses":
        start = F.array(y[0])
    elif kind == "holt":
        start = F.array(y[0], y[1] - y[0])
    else:
        level, later = mean(F.slice(y, 1, m)), mean(F.slice(y, m + 1, m))
        season = F.reverse(F.transform(F.slice(y, 1, m), lambda v: v - level))
        start = F.concat(F.array(level, (later - level) / m), season)
    starts = first.select(*keys, start.alias("_start"))
    scored = score_grid(df, keys, pos, value, params, system, starts, "_start")
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("param", "sse", "state"), F.struct("sse", "param")).alias("b")).select(*keys, "b.*")
    last = df.groupBy(*keys).agg(F.max(pos).alias("_end"))
    best = attach(best, last, keys)
    fields = [f"`{k}` {best.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                p = params[int(row["param"])]
                a, b, h = system(p)
                s = np.asarray(row["state"], dtype=float)
                for step in range(1, horizon + 1):
                    yhat = float(h @ s)
                    s = a @ s + b * yhat
                    out.append({**{k: row[k] for k in keys}, "step": step, pos: row["_end"] + step, "yhat": yhat, "sse": row["sse"],
                                "level": p.get("level"), "trend": p.get("trend", 0.0), "season": p.get("season", 0.0)})
            if out:
                yield pd.DataFrame(out)

    return best.mapInPandas(run, ", ".join([*fields, f"step int, `{pos}` long, yhat double, sse double, level double, trend double, season double"]))


# ------------------------------------------------------------------ autoregression
def ar_forecast(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, max_order: int, horizon: int, d: int = 0,
                seasonal_d: int = 0, m: int = 1) -> DataFrame:
    """AR(p) on the differenced series, order by AIC: (series, step, pos, yhat, sigma, order).

    ``d`` first differences and ``seasonal_d`` differences over ``m`` slots are taken and undone again.
    ``sigma`` is the forecast standard error from the psi weights of the whole (differenced) filter.
    """
    keys = list(series_cols)
    taken = [1] * d + [m] * seasonal_d
    rows = df.select(*keys, pos, F.col(value).alias("_w"))
    for k in taken:
        rows = look_around(rows, keys, pos, {"_b": lag_of("_w", k)}).withColumn("_w", F.col("_w") - F.col("_b")).drop("_b")
    names = [f"_w{k}" for k in range(1, max_order + 1)]
    rows = look_around(rows, keys, pos, {n: lag_of("_w", k) for k, n in enumerate(names, 1)})
    cols = ["_w", *names]

    def solver(mo: Moments, _):
        best = None
        for p in range(0, max_order + 1):
            beta, _, ssr, _ = mo.fit("_w", names[:p])
            aic = mo.n * np.log(max(ssr, 1e-300) / mo.n) + 2 * (p + 2)
            if best is None or aic < best[0]:
                best = (aic, p, beta, ssr)
        _, p, beta, ssr = best
        return [{"order": p, "const": mo.intercept("_w", names[:p], beta), "phi": [float(b) for b in beta], "s2": float(ssr / max(1, mo.n - p - 1))}]

    fits = solve_rows(moment_rows(rows.na.drop(subset=cols), keys, cols), keys, cols, "order int, const double, phi array<double>, s2 double", solver)
    tail = max_order + sum(taken) + 1
    ends = df.groupBy(*keys).agg(F.max(pos).alias("_end"))
    recent = attach(df.select(*keys, pos, value), ends, keys).filter(F.col(pos) > F.col("_end") - tail)
    recent = recent.groupBy(*keys, "_end").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("y")))).alias("_y"))
    table = fits.join(recent, keys)
    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                levels = np.array([c["y"] for c in row["_y"]], dtype=float)
                full = np.concatenate([[1.0], -np.asarray(row["phi"], dtype=float)])
                diff = np.array([1.0])
                for k in taken:
                    step = np.zeros(k + 1)
                    step[0], step[k] = 1.0, -1.0
                    diff = np.convolve(diff, step)
                lags = -np.convolve(full, diff)[1:]  # y[t] = const + lags · past + shock
                psi = np.zeros(horizon)
                past = list(levels)
                var = 0.0
                for h in range(horizon):
                    psi[h] = 1.0 if h == 0 else sum(lags[i] * psi[h - 1 - i] for i in range(min(h, len(lags))))
                    var += row["s2"] * psi[h] ** 2
                    yhat = row["const"] + sum(lags[i] * past[-1 - i] for i in range(len(lags)))
                    past.append(yhat)
                    out.append({**{k: row[k] for k in keys}, "step": h + 1, pos: row["_end"] + h + 1, "yhat": float(yhat), "sigma": float(np.sqrt(var)), "order": row["order"]})
            if out:
                yield pd.DataFrame(out)

    return table.mapInPandas(run, ", ".join([*fields, f"step int, `{pos}` long, yhat double, sigma double, order int"]))


def decomposed_forecast(parts: DataFrame, series_cols: Sequence[str], pos: str, seasonal: Sequence[tuple[str, int]], value: str,
                        horizon: int, max_order: int = 4) -> DataFrame:
    """Forecast what the seasonal parts leave by AR on first differences, then add each seasonal part by phase."""
    keys = list(series_cols)
    rest = parts.withColumn("_rest", F.col(value) - sum((F.col(c) for c, _ in seasonal), F.lit(0.0)))
    out = ar_forecast(rest, keys, pos, "_rest", max_order, horizon, d=1)
    for c, period in seasonal:
        phase = parts.groupBy(*keys, F.pmod(F.col(pos), F.lit(period)).alias("_phase")).agg(F.max(c).alias(c))
        out = out.withColumn("_phase", F.pmod(F.col(pos), F.lit(period))).join(phase, [*keys, "_phase"]).drop("_phase")
        out = out.withColumn("yhat", F.col("yhat") + F.col(c)).drop(c)
    return out


# ------------------------------------------------------------------ regression per series
def linear_predictions(df: DataFrame, keys: Sequence[str], coefs: DataFrame, xs: Sequence[str], out: str) -> DataFrame:
    """Apply a coefficient table (one regression per key) to rows."""
    wide = coefs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("term", "coef"))).alias("_b"))
    rows = attach(df, wide, keys)
    total = F.element_at("_b", F.lit("intercept"))
    for x in xs:
        total = total + F.element_at("_b", F.lit(x)) * F.col(x)
    return rows.withColumn(out, total).drop("_b")


def harmonic_regression(train: DataFrame, future: DataFrame, series_cols: Sequence[str], value: str, xs: Sequence[str], out: str = "yhat"):
    """OLS on harmonics and other known columns for every series: (predictions, coefficient table)."""
    coefs = settle(regress(train, series_cols, value, xs))
    return linear_predictions(future, series_cols, coefs, xs, out), coefs


# ------------------------------------------------------------------ trees
def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(df.na.drop(subset=list(features)))


def boosted(train: DataFrame, features: Sequence[str], label: str, rounds: int = 20, depth: int = 4, seed: int = 0):
    """Gradient-boosted regression trees on all series together."""
    fit = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="yhat", maxIter=rounds, maxDepth=depth, seed=seed, maxBins=64)
    return fit.fit(assemble(train.filter(F.col(label).isNotNull()), features))


def predict(model, df: DataFrame, features: Sequence[str], out: str = "yhat", floor: float | None = None) -> DataFrame:
    rows = model.transform(assemble(df, features)).drop("_features").withColumnRenamed("yhat", out)
    return rows if floor is None else rows.withColumn(out, F.greatest(F.col(out), F.lit(floor)))


def log_boosted(train: DataFrame, features: Sequence[str], label: str, **kw):
    """Trees on log1p of the target; use :func:`log_predict` to come back."""
    return boosted(train.withColumn("_log", F.log1p(label)), features, "_log", **kw)


def log_predict(model, df: DataFrame, features: Sequence[str], out: str = "yhat") -> DataFrame:
    return predict(model, df, features, out).withColumn(out, F.expm1(out))


def recursive_forecast(model, history: DataFrame, series_cols: Sequence[str], pos: str, value: str, horizon: int, n_lags: int,
                       windows: Sequence[int], features: Sequence[str], store_every: int = 4) -> DataFrame:
    """Feed each prediction back as the newest lag. One step is one batch over all series.

    Only the slots a feature can reach are carried, and the carried rows are stored every few steps.
    """
    keys, reach = list(series_cols), max([n_lags, *windows])
    ends = history.groupBy(*keys).agg(F.max(pos).alias("_end"))
    carried = settle(attach(history.select(*keys, pos, value), ends, keys).filter(F.col(pos) > F.col("_end") - reach).drop("_end"))
    for step in range(1, horizon + 1):
        ends = carried.groupBy(*keys).agg(F.max(pos).alias("_end"))
        rows = attach(carried, ends, keys).filter(F.col(pos) > F.col("_end") - reach).withColumn("_k", F.col("_end") - F.col(pos) + 1)
        aggs = [F.max(F.when(F.col("_k") == k, F.col(value))).alias(f"lag{k}") for k in range(1, n_lags + 1)]
        for w in windows:
            inside = F.when(F.col("_k") <= w, F.col(value))
            aggs += [F.avg(inside).alias(f"rmean{w}"), F.stddev_samp(inside).alias(f"rstd{w}")]
        feats = rows.groupBy(*keys).agg(*aggs, (F.max("_end") + 1).alias(pos))
        new = predict(model, feats, features, value).select(*keys, pos, value)
        carried = carried.unionByName(new)
        if step % store_every == 0 or step == horizon:
            carried = settle(carried)
    made = attach(carried, history.groupBy(*keys).agg(F.max(pos).alias("_end")), keys)
    return made.filter(F.col(pos) > F.col("_end")).select(*keys, pos, (F.col(pos) - F.col("_end")).cast("int").alias("step"), F.col(value).alias("yhat"))


def direct_horizons(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, horizons: Sequence[int], base_lags: Sequence[int],
                    test_slots: int, **kw) -> DataFrame:
    """One model per horizon with lags no newer than the horizon: (horizon, n, mae, mape)."""
    ends = df.groupBy(*series_cols).agg((F.max(pos) - test_slots).alias("_cut"))
    out = None
    for h in horizons:
        feats = [f"lag_{h + k}" for k in base_lags]
        rows = attach(look_around(df, series_cols, pos, {f"lag_{h + k}": lag_of(value, h + k) for k in base_lags}), ends, series_cols)
        rows = settle(rows.na.drop(subset=feats))
        model = boosted(rows.filter(F.col(pos) <= F.col("_cut")), feats, value, **kw)
        e = F.abs(F.col(value) - F.col("yhat"))
        score = predict(model, rows.filter(F.col(pos) > F.col("_cut")), feats).agg(
            F.lit(h).alias("horizon"), F.count("*").alias("n"), F.avg(e).alias("mae"), (100 * F.avg(e / F.nullif(F.abs(value), F.lit(0.0)))).alias("mape"))
        out = score if out is None else out.unionByName(score)
    return out


def walk_forward_blocks(df: DataFrame, pos: str, blocks: Sequence[tuple[int, int]], fit: Callable[[DataFrame], object],
                        apply: Callable[[object, DataFrame], DataFrame], parallel: int = 2) -> DataFrame:
    """Refit before each block of slots and predict the block: ``blocks`` holds (first, last) slots.

    Blocks are independent Spark jobs, so a few run at a time from driver threads.
    """

    def one(item):
        number, (first, last) = item
        model = fit(df.filter(F.col(pos) < first))
        return apply(model, df.filter(F.col(pos).between(first, last))).withColumn("block", F.lit(number))

    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(one, enumerate(blocks)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def refit_blocks(first: int, last: int, slots: int) -> list[tuple[int, int]]:
    return [(a, min(a + slots - 1, last)) for a in range(first, last + 1, slots)]

