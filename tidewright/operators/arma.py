"""Autoregression with moving-average terms for panels, by regression on estimated shocks.

A long autoregression gives each slot's shock; the series is then regressed on its own lags and on lagged shocks. Both regressions come from moments (one aggregate for
all series), and so does the choice of orders: every candidate is a sub-matrix of the same moments. Nothing iterates over a series.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.gram import Moments, moment_rows, solve_rows
from tidewright.operators.ordering import attach, lag_of, look_around
from tidewright.session import settle

#: Last slots of a series from which its latest shocks are worked out; what came before counts by a factor of LARGEST to this power at most.
TAIL = 800
#: Modulus to which roots of a moving average are drawn in, where they are larger: else shocks can't be told from the past.
LARGEST = 0.98


def inverted(theta: Sequence[float], lags: Sequence[int]) -> list[float]:
    """Moving-average coefficients whose filter fades: those that don't are drawn in, each by a power of its lag."""
    if not len(theta):
        return []
    poly = np.zeros(max(lags) + 1)
    poly[0] = 1.0
    for t, k in zip(theta, lags):
        poly[k] = t
    largest = max(np.abs(np.roots(poly)), default=0.0)
    shrink = min(1.0, LARGEST / largest) if largest > 0 else 1.0
    return [float(t * shrink ** k) for t, k in zip(theta, lags)]


def _lags(order: int, seasonal: int, m: int) -> list[int]:
    """Lags of a product of an ordinary and a seasonal polynomial; their coefficients are free."""
    return sorted({i + j * m for i in range(order + 1) for j in range(seasonal + 1)} - {0})


def arma_forecast(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, horizon: int, p: int = 1, q: int = 1, d: int = 0, seasonal_d: int = 0, m: int = 1,
                  seasonal_p: int = 0, seasonal_q: int = 0, long_lags: Sequence[int] | None = None, choose: bool = True) -> DataFrame:
    """ARMA on the differenced series: (series, step, pos, yhat, sigma, ar, ma), ``ar`` and ``ma`` being maps from lags to coefficients.

    With ``choose``, orders up to ``p``, ``q``, ``seasonal_p``, ``seasonal_q`` are compared by AIC on the same rows; else those are taken. ``sigma`` is the forecast
    standard error from the psi weights of the whole filter, differences included. Slots need to be consecutive; rows with a missing lag aren't fitted on.
    """
    keys = list(series_cols)
    taken = [1] * d + [m] * seasonal_d
    season = bool(seasonal_p or seasonal_q or seasonal_d) and m > 1
    long = list(long_lags or (sorted({1, 2, 3, 4, m - 1, m, m + 1, 2 * m} - {0}) if season else range(1, 11)))
    rows = df.select(*keys, F.col(pos).alias("_pos"), F.col(value).cast("double").alias("_w"))
    for k in taken:
        rows = look_around(rows, keys, "_pos", {"_b": lag_of("_w", k)}).withColumn("_w", F.col("_w") - F.col("_b")).drop("_b")
    rows = settle(rows)

    # shocks by a long autoregression
    names = [f"_l{k}" for k in long]
    wide = settle(look_around(rows, keys, "_pos", {n: lag_of("_w", k) for n, k in zip(names, long)}))
    cols = ["_w", *names]

    def shocks(mo: Moments, _):
        beta, *_ = mo.fit("_w", names)
        return [{"_const": mo.intercept("_w", names, beta), "_beta": [float(b) for b in beta]}]

    first = solve_rows(moment_rows(wide.na.drop(subset=cols), keys, cols), keys, cols, "_const double, _beta array<double>", shocks)
    e = F.col("_w") - F.col("_const")
    for i, n in enumerate(names):
        e = e - F.col("_beta")[i] * F.col(n)
    joined = wide.join(first, keys) if keys else wide.crossJoin(F.broadcast(first))  # without keys: one row
    rows = joined.select(*keys, "_pos", "_w", e.alias("_e"))

    # the series on its own lags and on lagged shocks
    most_ar, most_ma = _lags(p, seasonal_p, m), _lags(q, seasonal_q, m)
    own, past = [f"_w{k}" for k in most_ar], [f"_e{k}" for k in most_ma]
    rows = look_around(rows, keys, "_pos", {**{n: lag_of("_w", k) for n, k in zip(own, most_ar)}, **{n: lag_of("_e", k) for n, k in zip(past, most_ma)}})
    cols = ["_w", *own, *past]
    orders = list(itertools.product(range(p + 1), range(q + 1), range(seasonal_p + 1), range(seasonal_q + 1))) if choose else [(p, q, seasonal_p, seasonal_q)]

    def solver(mo: Moments, _):
        best = None
        for a, b, sa, sb in orders:
            ar, ma = _lags(a, sa, m), _lags(b, sb, m)
            beta, _, ssr, _ = mo.fit("_w", [f"_w{k}" for k in ar] + [f"_e{k}" for k in ma])
            aic = mo.n * np.log(max(ssr, 1e-300) / mo.n) + 2 * (len(ar) + len(ma) + 2)
            if best is None or aic < best[0] - 1e-9:
                best = (aic, ar, ma, beta, ssr)
        _, ar, ma, beta, ssr = best
        xs = [f"_w{k}" for k in ar] + [f"_e{k}" for k in ma]
        return [{"_const": mo.intercept("_w", xs, beta), "_ar": ar, "_phi": [float(v) for v in beta[:len(ar)]], "_ma": ma,
                 "_theta": inverted(beta[len(ar):], ma), "_s2": float(ssr / max(1, mo.n - len(ar) - len(ma) - 1))}]

    fits = solve_rows(moment_rows(rows.na.drop(subset=cols), keys, cols), keys, cols,
                      "_const double, _ar array<int>, _phi array<double>, _ma array<int>, _theta array<double>, _s2 double", solver)
    tail = max(TAIL, 4 * max([0, *most_ar, *most_ma]) + sum(taken))
    ends = df.groupBy(*keys).agg(F.max(pos).alias("_end"))
    recent = attach(df.select(*keys, F.col(pos).alias("_pos"), F.col(value).cast("double").alias("_y")), ends, keys).filter(F.col("_pos") > F.col("_end") - tail)
    recent = recent.groupBy(*keys, "_end").agg(F.array_sort(F.collect_list(F.struct("_pos", "_y"))).alias("_past"))  # ``tail`` rows at most
    table = fits.join(recent, keys) if keys else fits.crossJoin(F.broadcast(recent))
    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                y = np.array([c["_y"] for c in row["_past"]], dtype=float)
                ar, ma = dict(zip(row["_ar"], row["_phi"])), dict(zip(row["_ma"], row["_theta"]))
                w = y
                for k in taken:
                    w = w[k:] - w[:-k]
                e = np.zeros(len(w))
                for t in range(max([0, *ar]), len(w)):
                    e[t] = w[t] - row["_const"] - sum(c * w[t - k] for k, c in ar.items()) - sum(c * e[t - k] for k, c in ma.items() if k <= t)
                full = np.zeros(max([0, *ar]) + 1)
                full[0] = 1.0
                for k, c in ar.items():
                    full[k] = -c
                for k in taken:
                    step = np.zeros(k + 1)
                    step[0], step[k] = 1.0, -1.0
                    full = np.convolve(full, step)
                lags, past, shock, psi, var = -full[1:], list(y), list(e), [], 0.0
                for h in range(horizon):
                    psi.append(1.0 if h == 0 else ma.get(h, 0.0) + sum(lags[i] * psi[h - 1 - i] for i in range(min(h, len(lags)))))
                    var += row["_s2"] * psi[h] ** 2
                    yhat = row["_const"] + sum(v * past[-1 - i] for i, v in enumerate(lags)) + sum(c * shock[-k] for k, c in ma.items())
                    past.append(yhat)
                    shock.append(0.0)
                    out.append({**{k: row[k] for k in keys}, "step": h + 1, "_at": row["_end"] + h + 1, "yhat": float(yhat), "sigma": float(np.sqrt(var)), "ar": ar, "ma": ma})
            if out:
                yield pd.DataFrame(out)

    schema = ", ".join([*fields, "step int, _at long, yhat double, sigma double, ar map<int,double>, ma map<int,double>"])
    return table.mapInPandas(run, schema).withColumnRenamed("_at", pos)
