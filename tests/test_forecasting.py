"""Recursions, forecasts, splits, intervals and imputation against direct computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import anomaly, features as ft, forecast as fc, impute, learn, recursion, risk, scoring as sc, simulate
from tidewright.operators.grid import rebuild_level
from tidewright.operators.ordering import lag_of, look_around


def _panel(spark, series):
    rows = [(k, i, None if v is None or np.isnan(v) else float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "s string, p long, v double").repartition(4)


@pytest.fixture(scope="module")
def seasonal(spark):
    rng = np.random.default_rng(11)
    t = np.arange(240)
    series = {"a": 50 + 0.05 * t + 10 * np.sin(2 * np.pi * t / 12) + rng.normal(size=240), "b": 20 + 5 * np.cos(2 * np.pi * t / 12) + rng.normal(size=240)}
    return _panel(spark, series), series


@pytest.mark.parametrize("block", [16, 4096])
def test_affine_filter_equals_the_loop(spark, block):
    rng = np.random.default_rng(12)
    u = rng.normal(size=100)
    df = _panel(spark, {"a": u, "b": u[::-1]}).withColumn("start", F.lit(2.0))
    out = recursion.affine_filter(df, ["s"], "p", {"x": "v"}, 0.9, {"x": "start"}, block=block).filter("s = 'a'").toPandas().sort_values("p")
    s, want = 2.0, []
    for v in u:
        s = 0.9 * s + v
        want.append(s)
    assert np.allclose(out["x"], want)


def _holt_winters_by_hand(y, m, a, b, g):
    level, trend = y[:m].mean(), (y[m:2 * m].mean() - y[:m].mean()) / m
    season, sse = list(y[:m] - level), 0.0
    for i, v in enumerate(y):
        err = v - (level + trend + season[i % m])
        sse += err ** 2
        level, trend = level + trend + a * err, trend + a * b * err
        season[i % m] += g * err
    return sse, level, trend, season


@pytest.mark.parametrize("block", [32, 4096])
def test_holt_winters_equals_the_loop(seasonal, block, monkeypatch):
    df, series = seasonal
    grid = [{"level": 0.3, "trend": 0.1, "season": 0.2}]
    monkeypatch.setattr(fc, "score_grid", lambda *a, **k: recursion.score_grid(*a, **{**k, "block": block}))
    out = fc.smoothing_forecast(df, ["s"], "p", "v", "holt_winters", 5, m=12, grid=grid).toPandas().sort_values(["s", "step"])
    for name, y in series.items():
        sse, level, trend, season = _holt_winters_by_hand(y, 12, 0.3, 0.1, 0.2)
        got = out[out.s == name]
        assert np.allclose(got["sse"], sse)
        assert np.allclose(got["yhat"], [level + trend * h + season[(240 + h - 1) % 12] for h in range(1, 6)])


def test_garch_grid_recovers_persistence(spark):
    rng = np.random.default_rng(13)
    n, h = 4000, 1.0
    e = np.zeros(n)
    for i in range(n):
        e[i] = np.sqrt(h) * rng.normal()
        h = 0.05 + 0.08 * e[i] ** 2 + 0.87 * h
    fit = risk.garch_fit(_panel(spark, {"g": e}), ["s"], "p", "v").first()
    assert 0.85 < fit["persistence"] < 0.99 and fit["sigma2_next"] > 0
    alone = risk.garch_fit(_panel(spark, {"g": e}).drop("s"), [], "p", "v").first()
    assert alone["persistence"] == fit["persistence"]
    calm = risk.garch_fit(_panel(spark, {"w": rng.normal(size=2000)}), ["s"], "p", "v").first()
    assert calm["alpha"] <= 0.05
    path = risk.volatility_term_structure(risk.garch_fit(_panel(spark, {"g": e}), ["s"], "p", "v"), ["s"], 200, 1).orderBy("step").toPandas()
    assert abs(path["annual_vol"].iloc[-1] - fit["long_run_vol"]) < abs(path["annual_vol"].iloc[0] - fit["long_run_vol"]) + 1e-9


def test_autoregression_and_its_interval(spark):
    rng = np.random.default_rng(14)
    y = np.zeros(3000)
    for i in range(1, 3000):
        y[i] = 0.8 * y[i - 1] + rng.normal()
    out = fc.ar_forecast(_panel(spark, {"a": y}), ["s"], "p", "v", 4, 20).toPandas().sort_values("step")
    assert abs(out["sigma"].iloc[0] - 1) < 0.05 and abs(out["sigma"].iloc[-1] - 1 / np.sqrt(1 - 0.64)) < 0.15
    walk = fc.ar_forecast(_panel(spark, {"w": np.arange(200.0) * 2}), ["s"], "p", "v", 1, 3, d=1).toPandas().sort_values("step")
    assert np.allclose(walk["yhat"], [400, 402, 404], atol=1e-6)


def test_harmonic_regression_keeps_phase(spark):
    from tidewright.functions.columns import fourier
    t = np.arange(300)
    df = _panel(spark, {"a": 5 + 2 * np.sin(2 * np.pi * t / 24)})
    terms = fourier(F.col("p"), 0, [(24, 1)])
    rows = df.select("*", *[c.alias(n) for n, c in terms.items()])
    pred, _ = fc.harmonic_regression(rows.filter("p < 250"), rows.filter("p >= 250"), ["s"], "v", list(terms))
    assert pred.select(F.max(F.abs(F.col("v") - F.col("yhat")))).first()[0] < 1e-8


def test_baselines_and_walk_forward(seasonal):
    df, series = seasonal
    out = sc.baselines(df, ["s"], "p", "v", 14, 12).filter("s = 'a'").toPandas().pivot(index="step", columns="model", values="yhat")
    y = series["a"]
    assert np.allclose(out["seasonal_naive"], [y[-12 + (i % 12)] for i in range(14)]) and np.allclose(out["mean"], y.mean())
    assert np.allclose(out["drift"], y[-1] + (y[-1] - y[0]) / 239 * np.arange(1, 15))
    walk = sc.one_step_walk(df, ["s"], "p", "v", 12, 100).filter("s = 'a' AND model = 'mean'").toPandas().sort_values("p")
    assert np.allclose(walk["yhat"], [y[:i].mean() for i in range(100, 240)])


def test_metrics_near_zero(spark):
    df = spark.createDataFrame([(100.0, 110.0), (50.0, 55.0), (1.0, 3.0), (80.0, 85.0)], "y double, p double")
    m = sc.accuracy(df, [], "y", "p").first()
    assert round(m["mape"], 1) == 56.6 and round(m["wape"], 1) == 9.5


def test_folds_are_ordered_and_disjoint(seasonal):
    df, _ = seasonal
    for mode in ("expanding", "sliding"):
        f = ft.folds(df, ["s"], "p", 4, 24, mode, gap=2).groupBy("s", "fold", "role").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("*").alias("n")).toPandas()
        train, test = f[f.role == "train"].set_index(["s", "fold"]), f[f.role == "test"].set_index(["s", "fold"])
        assert (test["a"] - train["b"] == 3).all() and (test["n"] == 24).all()
        assert (test.loc["a"].sort_index()["a"].to_numpy()[1:] > test.loc["a"].sort_index()["b"].to_numpy()[:-1]).all()


def test_safe_features_ignore_the_recent_past(spark):
    y = np.arange(60.0)
    z = y.copy()
    z[50:] += 1000
    made = [ft.horizon_safe(_panel(spark, {"a": v}), ["s"], "p", "v", 10, [10, 12], [("m", 5, 10)]).filter("p = 59").first() for v in (y, z)]
    assert [made[0][c] for c in ("lag_10", "lag_12", "m")] == [made[1][c] for c in ("lag_10", "lag_12", "m")]
    with pytest.raises(ValueError):
        ft.horizon_safe(_panel(spark, {"a": y}), ["s"], "p", "v", 10, [9])


def test_difference_then_rebuild_is_identity(seasonal):
    df, _ = seasonal
    rows = look_around(df, ["s"], "p", {"l": lag_of("v")}).withColumn("d", F.col("v") - F.col("l"))
    first = df.filter("p = 0").select("s", F.col("v").alias("base"))
    back = rebuild_level(rows.filter("p > 0"), ["s"], "p", "d", first, "base", "x")
    assert back.select(F.max(F.abs(F.col("x") - F.col("v")))).first()[0] < 1e-9


def test_conformal_coverage_holds(spark):
    rng = np.random.default_rng(15)
    df = spark.createDataFrame(pd.DataFrame({"y": rng.normal(size=4000), "p": np.zeros(4000), "i": np.arange(4000)}))
    radius = sc.conformal_radius(df.filter("i % 2 = 0"), [], "y", "p", 0.1).first()["radius"]
    c = sc.coverage(df.filter("i % 2 = 1").withColumn("lo", F.lit(-radius)).withColumn("hi", F.lit(radius)), [], "y", "lo", "hi").first()
    assert c["coverage"] > 0.88


def test_change_points_find_the_steps(spark):
    rng = np.random.default_rng(16)
    y = np.concatenate([rng.normal(0, 1, 150), rng.normal(6, 1, 100), rng.normal(-3, 1, 120)])
    df = _panel(spark, {"a": y, "b": y[::-1]})
    out = anomaly.change_points(df, ["s"], "p", "v", 2, 20).filter("s = 'a'").toPandas()
    assert sorted(abs(np.array(sorted(out["break_pos"])) - [150, 250]).tolist())[-1] <= 3
    stopped = anomaly.change_points(df, ["s"], "p", "v", 5, 20, penalty=100.0)
    assert stopped.filter("s = 'a'").count() == 2
    means = anomaly.segment_means(df, ["s"], "p", "v", out_df := anomaly.change_points(df, ["s"], "p", "v", 2, 20)).filter("s = 'a'").orderBy("segment").toPandas()
    assert out_df is not None and np.allclose(means["mean"], [0, 6, -3], atol=0.4)


def test_injected_gaps_hide_only_known_values(spark):
    rng = np.random.default_rng(17)
    y = rng.normal(size=800)
    for a, k in ((50, 3), (200, 8), (400, 1), (600, 20)):
        y[a:a + k] = np.nan
    df = _panel(spark, {"a": y})
    marked, report = impute.inject_gaps(df, ["s"], "p", "v", 15, seed=3)
    rows = marked.filter("masked").toPandas()
    assert rows["v"].notna().all() and set(rows["gap_len"]) <= {1, 3, 8, 20}
    assert 0 < report.first()["placed"] <= 15
    again, _ = impute.inject_gaps(df.repartition(9), ["s"], "p", "v", 15, seed=3)
    assert sorted(again.filter("masked").toPandas()["p"]) == sorted(rows["p"])


def test_regression_fill_uses_the_covariates(spark):
    x = np.arange(200.0)
    df = spark.createDataFrame([(i, float(v), None if i % 10 == 3 else float(3 * v + 1)) for i, v in enumerate(x)], "p long, x double, v double")
    out = impute.regression_fill(df, ["v"], ["x"]).toPandas().sort_values("p")
    assert np.allclose(out["v"], 3 * x + 1, atol=1e-2)


def test_cut_points_beat_rounding(spark):
    rng = np.random.default_rng(18)
    grade = rng.choice([3, 4, 5, 6], 2000, p=[0.05, 0.45, 0.45, 0.05])
    s = 4.5 + 0.35 * (grade - 4.5) + rng.normal(0, 0.15, 2000)  # shrunk scores, as regressors give
    df = spark.createDataFrame(pd.DataFrame({"s": s, "g": grade}))
    cuts = learn.best_cuts(df, "s", "g", [3, 4, 5, 6])
    rep = lambda d, c: learn.grade_report(learn.confusion(d, "g", c)).first()["kappa"]
    rounded = df.withColumn("r", learn.to_grade(F.col("s"), 3, 6))
    assert rep(learn.apply_cuts(df, "s", cuts, [3, 4, 5, 6], "c"), "c") > rep(rounded, "r") + 0.1


def test_scenario_noise_has_the_stated_spread(spark):
    df = spark.createDataFrame([("a", i, 1000.0) for i in range(300)], "s string, p long, w double")
    out = simulate.scenarios(df, ["s"], "p", {"w": 5.0}, 60, phi=0.8, seed=2)
    sd = out.filter("p > 50").agg(F.stddev("w")).first()[0]
    assert abs(sd - 5.0) < 0.5
    same = simulate.scenarios(df.repartition(7), ["s"], "p", {"w": 5.0}, 3, seed=2).agg(F.sum("w")).first()[0]
    assert same == pytest.approx(simulate.scenarios(df, ["s"], "p", {"w": 5.0}, 3, seed=2).agg(F.sum("w")).first()[0])


def test_forest_quantiles_never_cross(spark):
    rng = np.random.default_rng(19)
    x = rng.uniform(0, 10, 1500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": x + rng.normal(0, 1 + 0.3 * x)}))
    out = learn.forest_quantiles(df, df, ["x"], "y", {"lo": 0.1, "mid": 0.5, "hi": 0.9}, trees=4, depth=3)
    r = out.agg(F.count("*"), F.count_if((F.col("lo") <= F.col("mid")) & (F.col("mid") <= F.col("hi"))), F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("int"))).first()
    assert r[0] == r[1] == 1500 and 0.7 < r[2] < 0.9


def test_shapley_adds_up(spark):
    from tidewright.operators.explain import permutation_importance, sampled_shapley
    rng = np.random.default_rng(20)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "a": rng.normal(size=200), "b": rng.normal(size=200), "c": rng.normal(size=200)}))
    predict = lambda d: d.withColumn("yhat", 3 * F.col("a") + F.col("b") * F.col("b"))
    out = sampled_shapley(df, "id", ["a", "b", "c"], predict, 4).groupBy("id").agg(F.sum("attribution").alias("s"), F.max(F.col("yhat") - F.col("base")).alias("g"))
    assert out.agg(F.max(F.abs(F.col("s") - F.col("g")))).first()[0] < 1e-9
    rows = df.withColumn("y", 3 * F.col("a") + F.col("b") * F.col("b"))
    imp = permutation_importance(rows, "id", ["a", "b", "c"], predict, (F.col("y") - F.col("yhat")) ** 2).toPandas().set_index("feature")["rise"]
    assert imp["a"] > imp["b"] > imp["c"] == 0.0


def test_smote_brings_every_class_to_the_largest(spark):
    from tidewright.operators.learn import smote_balanced
    rows = [(i, 1, float(i), 2.0 * i) for i in range(40)] + [(100 + i, 2, 100.0 + i, 50.0 - i) for i in range(9)] + [(200, 3, -1.0, -2.0)]
    out = smote_balanced(spark.createDataFrame(rows, "id long, grade int, a double, b double"), "grade", "id", ["a", "b"]).toPandas()
    assert out.groupby("grade").size().to_dict() == {1: 40, 2: 40, 3: 40}
    made = out[out.new_id.notna()]
    assert len(made) == 70 and made[made.grade == 2].a.between(100, 108).all() and (made[made.grade == 3].a == -1).all()


def test_importance_is_the_mean_of_shuffles_and_attribution_takes_every_order(spark):
    from tidewright.operators.explain import permutation_importance, sampled_shapley
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), float((i % 7) * (i % 3))) for i in range(60)], "id long, a double, b double, y double").cache()
    predict = lambda d: d.withColumn("yhat", F.col("a") * F.col("b"))
    loss = (F.col("y") - F.col("yhat")) ** 2
    rise = lambda **k: {r["feature"]: r["rise"] for r in permutation_importance(df, "id", ["a", "b"], predict, loss, **k).collect()}
    single = [rise(seed=s) for s in range(3)]
    for f, v in rise(n_repeats=3).items():
        assert abs(v - sum(s[f] for s in single) / 3) < 1e-9
    two = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "id long, a double, b double")  # both orders meet both background rows
    assert {r["feature"]: r["attribution"] for r in sampled_shapley(two, "id", ["a", "b"], predict, 4).filter("id = 2").collect()} == {"a": 0.25, "b": 0.25}
