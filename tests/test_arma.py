"""Moving-average terms against the same two regressions by hand, and against known processes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators.arma import arma_forecast, inverted


def simulate(n, ar, ma, const=0.0, seed=0):
    e = np.random.default_rng(seed).normal(size=n + 300)
    w = np.zeros(n + 300)
    for t in range(60, n + 300):
        w[t] = const + e[t] + sum(c * w[t - k] for k, c in ar.items()) + sum(c * e[t - k] for k, c in ma.items())
    return w[300:]


def panel(spark, series):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)], "s string, p long, v double").repartition(4)


@pytest.fixture(scope="module")
def known(spark):
    series = {"arma": simulate(6000, {1: 0.7}, {1: 0.5}, 1.0), "ma": simulate(6000, {}, {1: 0.6, 2: -0.3}, seed=1), "ar": simulate(6000, {1: 0.5, 2: 0.3}, {}, seed=2)}
    return series, panel(spark, series)


def fitted(df, **kw):
    return {r["s"]: r for r in arma_forecast(df, ["s"], "p", "v", 5, **kw).filter("step = 1").collect()}


def test_coefficients_of_known_processes(known):
    _, df = known
    got = fitted(df, p=1, q=1, choose=False)["arma"]
    assert abs(got["ar"][1] - 0.7) < 0.05 and abs(got["ma"][1] - 0.5) < 0.06 and abs(got["sigma"] - 1) < 0.05
    chosen = fitted(df, p=2, q=2)
    assert abs(chosen["ma"]["ma"][1] - 0.6) < 0.08 and len(chosen["ma"]["ar"]) <= 1
    assert set(chosen["ar"]["ar"]) == {1, 2} and abs(chosen["ar"]["ar"][1] + chosen["ar"]["ar"][2] - 0.8) < 0.1


def by_hand(y, p, q, long, horizon):
    """The two regressions by least squares, shocks over the whole series, forecasts and psi weights by their definitions."""
    lagged = lambda v, k: np.r_[np.full(k, np.nan), v[:-k]]
    def ols(target, xs):
        x = np.column_stack([np.ones(len(target)), *xs])
        ok = ~np.isnan(x).any(axis=1) & ~np.isnan(target)
        b = np.linalg.lstsq(x[ok], target[ok], rcond=None)[0]
        return b, x, ok
    b, x, _ = ols(y, [lagged(y, k) for k in long])
    e = y - x @ b
    b, x, ok = ols(y, [lagged(y, k) for k in range(1, p + 1)] + [lagged(e, k) for k in range(1, q + 1)])
    s2 = ((y - x @ b)[ok] ** 2).sum() / (ok.sum() - len(b))
    shock = np.zeros(len(y))
    for t in range(p, len(y)):
        shock[t] = y[t] - b[0] - sum(b[k] * y[t - k] for k in range(1, p + 1)) - sum(b[p + k] * shock[t - k] for k in range(1, q + 1) if k <= t)
    past, rest, psi, out, var = list(y), list(shock), [], [], 0.0
    for h in range(horizon):
        psi.append(1.0 if h == 0 else (b[p + h] if h <= q else 0.0) + sum(b[k] * psi[h - k] for k in range(1, min(h, p) + 1)))
        var += s2 * psi[h] ** 2
        out.append((b[0] + sum(b[k] * past[-k] for k in range(1, p + 1)) + sum(b[p + k] * rest[-k] for k in range(1, q + 1)), var ** 0.5))
        past.append(out[-1][0])
        rest.append(0.0)
    return out


def test_forecast_equals_both_regressions_by_hand(known):
    series, df = known
    rows = arma_forecast(df, ["s"], "p", "v", 6, p=2, q=2, long_lags=[1, 2, 3, 4, 5], choose=False).orderBy("s", "step").collect()
    for name, y in series.items():
        want = by_hand(y, 2, 2, [1, 2, 3, 4, 5], 6)
        got = [(r["yhat"], r["sigma"]) for r in rows if r["s"] == name]
        assert np.allclose(got, want, atol=1e-6), name


def test_differences_and_seasons(spark):
    n, m = 2400, 12
    w = simulate(n, {1: 0.4}, {1: 0.3, 12: 0.4, 13: 0.12}, seed=5)
    y = np.zeros(n)
    for t in range(n):
        y[t] = w[t] + (y[t - 1] if t else 0) + (y[t - m] if t >= m else 0) - (y[t - m - 1] if t > m else 0)
    df = panel(spark, {"a": y[:-24]})
    out = arma_forecast(df, ["s"], "p", "v", 24, p=1, q=1, d=1, seasonal_d=1, m=m, seasonal_q=1, choose=False).orderBy("step").collect()
    got = out[0]
    assert abs(got["ma"][12] - 0.4) < 0.12 and abs(got["ar"][1] - 0.4) < 0.25
    err = np.abs([r["yhat"] - v for r, v in zip(out, y[-24:])])
    assert [r["p"] for r in out] == list(range(n - 24, n)) and (err <= 3 * np.array([r["sigma"] for r in out])).all()
    one = arma_forecast(df.drop("s"), [], "p", "v", 3, p=1, q=1, d=1, choose=False)
    assert one.count() == 3


def test_what_does_not_fade_is_drawn_in():
    assert inverted([0.5], [1]) == [0.5] and inverted([], []) == []
    for theta, lags in (([2.0], [1]), ([-1.0], [1]), ([0.5, 3.0], [1, 12])):
        poly = np.zeros(max(lags) + 1)
        poly[0] = 1
        for t, k in zip(inverted(theta, lags), lags):
            poly[k] = t
        assert max(np.abs(np.roots(poly))) < 0.981


def test_no_rows(known):
    _, df = known
    assert arma_forecast(df.filter("p < 0"), ["s"], "p", "v", 3).count() == 0
