"""Statistics against known values, brute force and numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.functions import tails
from tidewright.operators import assoc, classify, decompose, diagnostics as dg, gram, multivariate as mv, neighbours, profile, risk


def test_tail_probabilities():
    assert math.isclose(tails.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.chi2_sf(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.t_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.f_sf(3.325834529923155, 5, 10), 0.05, rel_tol=1e-6)
    assert tails.normal_sf(0) == 0.5


def test_moments_are_bias_corrected(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 10.0, 20.0, 3.5)], "v double")
    m = profile.moments(df, "v").first()
    assert round(m["skew"], 4) == 1.8304 and round(m["excess_kurtosis"], 4) == 3.1340 and m["median"] == 3.5


def test_zero_mad_flags_nothing(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(50.0,)], "v double")
    assert profile.outlier_flags(df, "v").filter("mad_outlier").count() == 0


def test_kendall_against_pairs(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 200), rng.integers(0, 5, 200)
    c = d = 0
    for i in range(200):
        s = np.sign(a[i] - a[i + 1:]) * np.sign(b[i] - b[i + 1:])
        c, d = c + int((s > 0).sum()), d + int((s < 0).sum())
    out = assoc.kendall(spark.createDataFrame(pd.DataFrame({"a": a, "b": b})), "a", "b").first()
    assert (out["concordant"], out["discordant"]) == (c, d)


def test_cramers_v_counts_empty_cells(spark):
    pdf = pd.DataFrame({"a": ["x"] * 30 + ["y"] * 30 + ["z"] * 30, "b": ["p"] * 30 + ["q"] * 30 + ["r"] * 30})
    out = assoc.cramers_v(spark.createDataFrame(pdf), "a", "b").first()
    assert math.isclose(out["chi2"], 180.0) and math.isclose(out["v"], 1.0, rel_tol=1e-9)


def test_nearest_with_cells_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 4)), 1)  # coarse values give ties
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(id=np.arange(400), g=rng.choice(["u", "v"], 400))
    df = spark.createDataFrame(pdf)
    out = neighbours.nearest(df, df, "id", "id", list("abcd"), 4, ["g"], exclude_same_id=True, n_cuts=4, n_dims=3).toPandas()
    got = out.sort_values(["id", "place"]).groupby("id")["id_near"].apply(list)
    for i in range(400):
        same = pdf[(pdf.g == pdf.g[i]) & (pdf.id != i)]
        dist = np.zeros(len(same))
        for f in range(4):
            dist += (x[i, f] - same[list("abcd")].to_numpy()[:, f]) ** 2
        order = np.lexsort((same.id.to_numpy(), np.sqrt(dist)))[:4]
        assert got[i] == same.id.to_numpy()[order].tolist()


def test_regression_matches_numpy_on_both_moment_paths(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3)) + 1e4
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["x1", "x2", "x3"]).assign(y=y, k="k"))
    want = np.linalg.lstsq(np.column_stack([np.ones(500), x]), y, rcond=None)[0]
    for wide in (120, 1):
        monkeypatch.setattr(gram, "WIDE", wide)
        out = gram.regress(df, [], "y", ["x1", "x2", "x3"]).toPandas().set_index("term")["coef"]
        assert np.allclose([out["x1"], out["x2"], out["x3"]], want[1:], rtol=1e-6)


def _series(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "s string, p long, v double")


@pytest.fixture(scope="module")
def known(spark):
    rng = np.random.default_rng(6)
    n, e = 2000, rng.normal(size=2000)
    ar = np.zeros(n)
    for i in range(1, n):
        ar[i] = 0.7 * ar[i - 1] + e[i]
    t = np.arange(n)
    series = {"noise": e, "walk": np.cumsum(e), "ar": ar, "sine": 3 * np.sin(2 * np.pi * t / 24) + np.sin(2 * np.pi * t / 168) + 0.1 * e,
              "step": e + 4 * (t >= 1200)}
    df = None
    for k, v in series.items():
        part = _series(spark, v, k)
        df = part if df is None else df.unionByName(part)
    return df.cache(), series


def _adf_by_hand(y, p):
    d = np.diff(y)
    x = np.column_stack([y[p:-1]] + [d[p - k:len(d) - k] for k in range(1, p + 1)] + [np.ones(len(d) - p)])
    b, *_ = np.linalg.lstsq(x, d[p:], rcond=None)
    e = d[p:] - x @ b
    s2 = e @ e / (len(e) - x.shape[1])
    return b[0] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[0, 0])


def test_unit_root_statistics_and_verdicts(known):
    df, series = known
    a = dg.adf(df, ["s"], "p", "v", 6).toPandas().set_index("s")
    for name in ("noise", "walk", "ar"):
        assert math.isclose(a["stat"][name], _adf_by_hand(series[name], int(a["lag"][name])), rel_tol=1e-6)
    v = dg.stationarity_report(df, ["s"], "p", "v", 6, n_lags=20).toPandas().set_index("s")["verdict"]
    assert v["noise"] == "STATIONARY" and v["walk"].startswith("NON-STATIONARY")


def test_kpss_automatic_bandwidth(known):
    df, series = known
    out = dg.kpss(df, ["s"], "p", "v").toPandas().set_index("s")
    y = series["ar"] - series["ar"].mean()
    n = len(y)
    lags = int(n ** (2 / 9))
    s0, s1 = y @ y / n, 0.0
    for i in range(1, lags + 1):
        prod = y[i:] @ y[:n - i] / (n / 2)
        s0, s1 = s0 + prod, s1 + i * prod
    width = int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))
    var = (y @ y + 2 * sum(y[i:] @ y[:n - i] * (1 - i / (width + 1)) for i in range(1, width + 1))) / n
    assert out["n_lags"]["ar"] == width
    assert math.isclose(out["stat"]["ar"], (np.cumsum(y) ** 2).sum() / n ** 2 / var, rel_tol=1e-9)


def test_white_noise_and_dependence(known):
    df, series = known
    q = dg.ljung_box(df.filter("s IN ('noise', 'ar')"), ["s"], "p", "v", 10).filter("lag = 10").toPandas().set_index("s")
    assert q["p_value"]["noise"] > 0.01 and q["p_value"]["ar"] < 1e-6
    p = dg.pacf(df.filter("s = 'ar'"), ["s"], "p", "v", 3).toPandas().set_index("lag")["pacf"]
    assert abs(p[1] - 0.7) < 0.06 and abs(p[2]) < 0.08


def test_periods_entropy_and_memory(known):
    df, _ = known
    power = dg.power_at(df.filter("s = 'sine'"), ["s"], "p", "v", [12, 24, 100, 168]).toPandas().set_index("period")["power"]
    assert power[24.0] > power[168.0] > 10 * power[100.0]
    ent = dg.spectral_entropy(df.filter("s IN ('sine', 'noise')"), ["s"], "p", "v", 168).toPandas().set_index("s")["entropy"]
    assert ent["sine"] < 0.5 < 0.9 < ent["noise"]
    h = dg.hurst(df.filter("s IN ('noise', 'walk')"), ["s"], "p", "v").toPandas().set_index("s")["hurst"]
    assert 0.4 < h["noise"] < 0.7 and h["walk"] > 0.9


def test_decomposition_adds_up_and_strengths_are_bounded(known):
    df, _ = known
    parts = decompose.multi_seasonal(df.filter("s = 'sine'"), ["s"], "p", "v", [24, 168])
    gap = parts.select((F.col("v") - F.col("trend") - F.col("seasonal_24") - F.col("seasonal_168") - F.col("resid")).alias("g")).agg(F.max(F.abs("g"))).first()[0]
    assert gap < 1e-9
    s = decompose.strengths(parts, ["s"], ["seasonal_24", "seasonal_168"]).first()
    assert s["seasonal_24_strength"] > 0.95 and 0 <= s["trend_strength"] <= 1


def test_granger_matches_nested_least_squares(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=600)
    y = np.roll(x, 1) * 0.8 + rng.normal(size=600)
    wide = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "p long, y double, x double")
    out = mv.granger(wide, "p", ["y", "x"], 2).toPandas().set_index(["effect", "cause", "lag"])
    lag = lambda v, k: v[2 - k:len(v) - k]
    own = np.column_stack([np.ones(598), lag(y, 1), lag(y, 2)])
    full = np.column_stack([own, lag(x, 1), lag(x, 2)])
    ssr = [np.sum((y[2:] - m @ np.linalg.lstsq(m, y[2:], rcond=None)[0]) ** 2) for m in (own, full)]
    assert math.isclose(out.loc[("y", "x", 2), "f"], (ssr[0] - ssr[1]) / 2 / (ssr[1] / (598 - 5)), rel_tol=1e-6)
    assert out.loc[("y", "x", 2), "p_value"] < 1e-6


def test_components_of_a_common_factor(spark):
    rng = np.random.default_rng(8)
    f = rng.normal(size=500)
    pdf = pd.DataFrame({c: f + 0.2 * rng.normal(size=500) for c in ("a", "b", "c")}).assign(id=np.arange(500))
    df = spark.createDataFrame(pdf)
    load = mv.principal_components(df, ["a", "b", "c"])
    first = load.filter("component = 1").toPandas()
    assert (first["loading"] > 0).all() and first["explained"].iloc[0] > 0.9
    scores = mv.component_scores(df, ["a", "b", "c"], load, 1).toPandas()
    assert abs(np.corrcoef(scores.sort_values("id")["pc1"], f)[0, 1]) > 0.95


def test_cointegrated_pair_is_found(spark):
    rng = np.random.default_rng(9)
    w, z = np.cumsum(rng.normal(size=1500)), np.cumsum(rng.normal(size=1500))
    wide = spark.createDataFrame([(i, float(2 * a + e), float(a), float(b)) for i, (a, b, e) in enumerate(zip(w, z, rng.normal(size=1500)))],
                                 "p long, y double, x double, other double")
    out = mv.engle_granger(wide, "p", [("y", "x"), ("y", "other")], 4).toPandas().set_index("pair")
    assert abs(out["beta"]["y|x"] - 2) < 0.05 and out["coint_p"]["y|x"] < 0.01 < out["coint_p"]["y|other"]


def test_kupiec_and_arch(spark, known):
    df, _ = known
    lm = risk.arch_lm(df.filter("s = 'noise'"), ["s"], "p", "v", 5).first()
    assert lm["p_value"] > 0.001
    table = spark.createDataFrame([(-2.0 if i < 50 else 1.0, 1.0) for i in range(1000)], "r double, var double")
    k = risk.kupiec(table, [], "r", "var", 0.05).first()
    assert k["breaches"] == 50 and abs(k["kupiec_lr"]) < 1e-9 and k["kupiec_p"] > 0.999


def test_kappa_falls_with_distance(spark):
    def kappa(pred):
        df = spark.createDataFrame(list(zip([5, 6, 7, 5, 6], pred)), "y int, g int")
        return classify.grade_report(classify.confusion(df, "y", "g")).first()["kappa"]
    assert kappa([5, 6, 7, 5, 6]) == 1.0 and kappa([6, 6, 7, 5, 6]) > kappa([8, 6, 7, 5, 6])


def test_half_even_grades(spark):
    df = spark.createDataFrame([(4.5,), (5.5,), (11.0,), (-1.0,)], "s double")
    assert [r[0] for r in df.select(classify.to_grade(F.col("s"), 3, 9)).collect()] == [4, 6, 9, 3]


def test_scores_with_tied_probabilities(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 1.0)], "y int, p double")
    assert classify.roc_auc(df, "y", "p").first()["auc"] == pytest.approx((2 * 2 + 1.5) / 6)
    assert classify.reliability(df, "y", "p").filter("band = 9").first()["n"] == 2  # the closed last band holds 1.0
    assert classify.average_precision(classify.pr_curve(df, "y", "p")).first()[0] == pytest.approx(2 / 3 + 3 / 4 / 3)


# ------------------------------------------------------------------ faults once found
def test_yates_counts_cells_that_never_occur(spark):
    from tidewright.operators import assoc
    rows = spark.createDataFrame([("x", "u")] * 12 + [("x", "v")] * 8 + [("y", "u")] * 10, "a string, b string")
    assert abs(assoc.cramers_v(rows, "a", "b").first()["chi2"] - 3.600852) < 1e-5
    rows = spark.createDataFrame([("x", "u")] * 6 + [("y", "v")] * 4, "a string, b string")
    assert abs(assoc.cramers_v(rows, "a", "b").first()["chi2"] - 6.267361) < 1e-5


def test_large_keys_hash_without_overflow(spark):
    from tidewright.functions.columns import portable_hash
    rows = spark.createDataFrame([(10**12,), (4 * 10**9,), (2**62,)], "k long")
    got = [r[0] for r in rows.select(portable_hash(F.col("k"))).collect()]
    assert got == [k * 2654435761 % 1_000_003 for k in (10**12, 4 * 10**9, 2**62)]


def test_every_gap_length_has_a_band(spark):
    from tidewright.operators.impute import gap_band
    rows = spark.createDataFrame([(1,), (12,), (48,), (49,), (12_000,)], "k int")
    assert [r[0] for r in rows.select(gap_band("k")).collect()] == ["1-3h", "4-12h", "13-48h", "49h+", "49h+"]


def test_pairs_of_three_hundred_entities(spark):
    import numpy as np
    from tidewright.operators.assoc import pair_correlations
    x = np.random.default_rng(3).normal(size=(300, 9))
    rows = spark.createDataFrame([(f"e{i:03d}", p, float(x[i, p])) for i in range(300) for p in range(9) if (i + p) % 7], "e string, p long, v double")
    got = {(r["a"], r["b"]): (r["n"], r["c"]) for r in pair_correlations(rows, "e", "p", "v", block=4, chunk=64).collect()}
    assert len(got) == 300 * 299 // 2
    for i, j in ((0, 1), (5, 250), (298, 299)):
        both = [p for p in range(9) if (i + p) % 7 and (j + p) % 7]
        n, c = got[f"e{i:03d}", f"e{j:03d}"]
        assert n == len(both) and abs(c - np.corrcoef(x[i, both], x[j, both])[0, 1]) < 1e-9


def test_nan_is_missing_at_the_source(spark, tmp_path):
    from tidewright.plans.registry import Tables
    spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "k long, v double").write.parquet(str(tmp_path / "t.parquet"))
    assert [r["v"] for r in Tables(spark, str(tmp_path)).t.orderBy("k").collect()] == [None, None, 1.5]


def test_backtest_ratio_without_breaches(spark):
    import math
    from tidewright.operators.risk import kupiec
    rows = spark.createDataFrame([("s", 0.1, 1.0)] * 50, "s string, r double, var double")
    got = kupiec(rows, ["s"], "r", "var", 0.05).first()
    assert got["breaches"] == 0 and abs(got["kupiec_lr"] + 100 * math.log(0.95)) < 1e-9


def test_neighbours_of_rows_with_missing_features(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4))
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(400)], "id long, a double, b double, c double, d double")
    got = {}
    for r in neighbours.nearest(rows, rows, "id", "id", ["a", "b", "c", "d"], 3, exclude_same_id=True, n_cuts=3).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["id_near"]
    for i in range(400):
        apart = (x - x[i]) ** 2
        both = (~np.isnan(apart)).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = np.where(both > 0, np.nansum(apart, axis=1) * 4 / both, np.inf)
        dist[i] = np.inf
        want = [int(j) for j in np.lexsort((np.arange(400), dist))[:3] if np.isfinite(dist[j])]
        assert [got.get(i, {}).get(p) for p in range(1, len(want) + 1)] == want


def test_calendar_composition(spark, small):
    import datetime as dt
    from collections import Counter

    from tidewright.operators.profile import calendar_composition
    from tidewright.plans import catalog
    days = [(r["cluster"], r["day"]) for r in catalog.QUERIES["m3_day_shape_clusters"](spark, small).collect()]
    got = {(r["cluster"], r["part"], r["item"]): r for r in catalog.QUERIES["m4_day_shapes_by_calendar"](spark, small).collect()}
    size, every, n = Counter(c for c, _ in days), Counter(d.isoweekday() for _, d in days), Counter((c, d.isoweekday()) for c, d in days)
    assert {(c, i) for c, part, i in got if part == "weekday"} == set(n)
    for (c, i), k in n.items():
        row = got[c, "weekday", i]
        assert row["n"] == k and abs(row["pct"] - 100 * k / size[c]) < 1e-5
        assert abs(row["lift"] - k / size[c] / (every[i] / len(days))) < 1e-5
    rows = [(None, dt.date(2024, 1, 1)), ("a", dt.date(2024, 1, 7)), ("a", None)]
    odd = {(r["g"], r["part"], r["item"]): (r["n"], r["pct"], r["all_pct"]) for r in calendar_composition(spark.createDataFrame(rows, "g string, d date"), "g", "d").collect()}
    assert odd == {(None, "weekday", 1): (1, 100, 50), (None, "month", 1): (1, 100, 100), ("a", "weekday", 7): (1, 100, 50), ("a", "month", 1): (1, 100, 100)}
    assert calendar_composition(spark.createDataFrame([], "g string, d date"), "g", "d").count() == 0
