"""Local regression and its decomposition against loops over slots, in one task and in blocks."""

import numpy as np
import pytest

from tidewright.operators import stl as L


def line_at(values, weights, window, x):
    """The definition for one slot: the nearest slots, tricube weights, a weighted line."""
    m = len(values)
    width = min(window, m)
    left = min(max(x - window // 2, 0), m - width)
    slots = [j for j in range(left, left + width)]
    h = max(abs(j - x) for j in slots) + max(window - m, 0) // 2
    use = [j for j in slots if np.isfinite(values[j])]
    k = np.array([weights[j] * max(1 - (abs(j - x) / h) ** 3, 0) ** 3 for j in use])
    if not use:
        return np.nan
    if k.sum() == 0:
        return np.mean([values[j] for j in use])
    a = np.array([[1.0, j - x] for j in use])
    s = np.sqrt(k)
    if (k > 0).sum() < 2:
        return float((k * np.array([values[j] for j in use])).sum() / k.sum())
    return np.linalg.lstsq(a * s[:, None], np.array([values[j] for j in use]) * s, rcond=None)[0][0]


def slow_stl(y, period, window, trend_window, inner, outer):
    n, low_window = len(y), period + 1 + period % 2
    trend, w = np.zeros(n), np.ones(n)
    for turn in range(outer + 1):
        if turn:
            r = np.abs(y - season - trend)  # noqa: F821
            h = 6 * np.nanmedian(r)
            w = np.where(np.isfinite(r), np.clip(1 - (np.nan_to_num(r) / h) ** 2, 0, None) ** 2, 1.0)
        for _ in range(inner):
            cycle = np.full(n + 2 * period, np.nan)
            for ph in range(period):
                sub, sw = (y - trend)[ph::period], w[ph::period]
                for x in range(-1, len(sub) + 1):
                    cycle[(x + 1) * period + ph] = line_at(sub, sw, window, x)
            low = cycle
            for width in (period, period, 3):
                low = np.array([low[i:i + width].mean() for i in range(len(low) - width + 1)])
            season = cycle[period:period + n] - np.array([line_at(low, np.ones(n), low_window, i) for i in range(n)])
            trend = np.array([line_at(y - season, w, trend_window, i) for i in range(n)])
    return trend, season, w


def make(n, seed, period=6):
    rng = np.random.default_rng(seed)
    y = 0.05 * np.arange(n) + 3 * np.sin(2 * np.pi * np.arange(n) / period) + rng.normal(size=n)
    y[rng.integers(0, n, 3)] += 40
    return y


def parts(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r["s"]), r["p"])):
        out.setdefault(r["s"], []).append([np.nan if r[c] is None else r[c] for c in ("trend", "seasonal", "robust")])
    return {k: np.array(v).T for k, v in out.items()}


@pytest.mark.parametrize("window", [3, 5, 9, 41])
def test_local_lines(window):
    y = make(30, 1)
    y[[4, 5, 20]] = np.nan
    w = np.random.default_rng(2).uniform(size=30) * (np.arange(30) % 7 > 0)
    at = np.arange(-1, 31)
    got = L.local_fit(y[None], w[None], window, at)[0]
    assert np.allclose(got, [line_at(y, w, window, x) for x in at], atol=1e-9)
    assert np.allclose(L.local_fit(2 + 3 * np.arange(30.0)[None], np.ones((1, 30)), window, at)[0], 2 + 3 * at)


def test_same_as_loops_in_one_task_and_in_blocks(spark):
    known = {"a": make(61, 3), "b": make(47, 4), None: make(200, 5)}
    known["a"][[7, 8, 30]] = np.nan
    rows = [(k, i + 100, None if np.isnan(v) else float(v), "extra") for k, y in known.items() for i, v in enumerate(y)]
    rows = [row for row in rows if row[:2] != ("b", 120)]
    known["b"][20] = np.nan
    df = spark.createDataFrame(rows, "s string, p long, v double, trend string").repartition(3)
    one = parts(L.stl(df, ["s"], "p", "v", 6, 7, 13, inner=1, outer=2))
    blocks = parts(L.stl(df, ["s"], "p", "v", 6, 7, 13, inner=1, outer=2, block=16))
    for name, y in known.items():
        keep = [i for i in range(len(y)) if not (name == "b" and i == 20)]
        for got in (one[name], blocks[name]):
            for x, want in zip(got, slow_stl(y, 6, 7, 13, 1, 2)):
                assert np.allclose(x, want[keep], atol=1e-7)


def test_long_series_runs_in_blocks(spark):
    y = make(2000, 6)
    df = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(y)], "s string, p long, v double")
    whole, cut = (parts(L.stl(df, ["s"], "p", "v", 6, block=b, inner=2, outer=1))["x"] for b in (4096, 100))
    assert np.allclose(whole, cut, atol=1e-9)


def test_robust_parts_pass_by_outliers(spark):
    n = 240
    clean = 0.1 * np.arange(n) + 5 * np.sin(2 * np.pi * np.arange(n) / 12)
    y = clean + np.random.default_rng(7).normal(size=n) * 0.1
    y[[50, 121, 190]] += 80
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "p long, v double")
    rows = sorted(L.stl(df, [], "p", "v", 12, robust=True).collect())
    off = np.array([r["trend"] + r["seasonal"] for r in rows]) - clean
    assert np.abs(off).max() < 0.5
    assert [r["p"] for r in rows if r["robust"] < 1e-6 and abs(r["resid"]) > 50] == [50, 121, 190]


def test_two_periods_are_told_apart(spark):
    i = np.arange(28 * 12)
    a, b = 3 * np.sin(2 * np.pi * i / 4), 5 * np.cos(2 * np.pi * i / 28)
    df = spark.createDataFrame([("x", int(k), float(v)) for k, v in zip(i, a + b + 10)], "s string, p long, v double")
    for block in (4096, 64):
        rows = sorted(L.multi_stl(df, ["s"], "p", "v", [28, 4], block=block).collect(), key=lambda r: r["p"])
        assert np.abs(np.array([r["seasonal_4"] for r in rows]) - a).max() < 0.05
        assert np.abs(np.array([r["seasonal_28"] for r in rows]) - b).max() < 0.05
        assert all(abs(r["v"] - r["trend"] - r["seasonal_4"] - r["seasonal_28"] - r["resid"]) < 1e-9 for r in rows)


def test_odd_and_empty_tables(spark):
    schema = "s string, p long, v double"
    assert L.stl(spark.createDataFrame([], schema), ["s"], "p", "v", 4).count() == 0
    rows = [("short", 1, 2.0), ("none", 1, None), ("none", 9, float("nan"))] + [("flat", i, 1.0) for i in range(12)]
    got = parts(L.stl(spark.createDataFrame(rows, schema), ["s"], "p", "v", 4, robust=True))
    assert np.isnan(got["short"][:2]).all() and np.isnan(got["none"][:2]).all()
    assert np.allclose(got["flat"][0], 1) and np.allclose(got["flat"][1], 0)
    with pytest.raises(ValueError):
        L.stl(spark.createDataFrame(rows, schema), ["s"], "p", "v", 4, seasonal_window=4)
