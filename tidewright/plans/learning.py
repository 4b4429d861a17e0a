"""Queries: forecasting models, classifiers, calibration, explanation and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import columns as C
from tidewright.functions.gridtime import slot_start
from tidewright.operators import (arma, boosting as bt, classify as cl, decompose, explain as ex, features as ft, forecast as fc, learn as ln,
                                  scoring as sc, simulate as sim)
from tidewright.operators.ordering import attach, lag_of, look_around, rolling
from tidewright.plans.panels import S, SQL_PREDICTIONS, TEST_HOURS, hourly_filled, r
from tidewright.plans.registry import query
from tidewright.session import settle

_ORIGIN = 473352
LAGS = ["lag_24", "lag_25", "lag_48", "lag_168", "roll24"]
CALENDAR = ["hour", "dow"]


def _panel(t):
    """Hourly panel with safe features; ``part`` marks the last week of each series."""
    rows = look_around(hourly_filled(t), S, "pos", {**{f"lag_{k}": lag_of("x", k) for k in (24, 25, 48, 168)}, "roll24": rolling("mean", "x", 24, 24)})
    rows = ft.split_last(rows, S, "pos", TEST_HOURS).withColumn("hour", F.hour("ts")).withColumn("dow", F.weekday("ts"))
    return settle(rows.na.drop(subset=["x", *LAGS]))


def _parts(t):
    rows = _panel(t)
    return rows.filter("part = 'train'"), rows.filter("part = 'test'")


def _split_x(t):
    rows = settle(ft.split_last(hourly_filled(t), S, "pos", TEST_HOURS).filter("x IS NOT NULL"))
    return rows.filter("part = 'train'"), rows.filter("part = 'test'")


def _scored(forecast, test):
    return forecast.join(test.select("series", "pos", "x"), ["series", "pos"])


_ALPHAS = ", ".join(f"({p['level']})" for p in fc.SMOOTHING_GRID["ses"])


@query("l8_simple_smoothing", f"""WITH RECURSIVE {SQL_PREDICTIONS},
tr AS (SELECT series, x, row_number() OVER (PARTITION BY series ORDER BY pos) AS i FROM preds WHERE part = 'train' AND x IS NOT NULL),
al AS (SELECT CAST(a AS DOUBLE) AS a FROM (VALUES {_ALPHAS}) AS v(a)),
rec AS (SELECT series, a, CAST(0 AS BIGINT) AS i, x AS lvl, CAST(0 AS DOUBLE) AS sse FROM tr, al WHERE i = 1
        UNION ALL SELECT rec.series, a, t.i, a * t.x + (1 - a) * lvl, sse + (t.x - lvl) * (t.x - lvl) FROM rec JOIN tr t ON t.series = rec.series AND t.i = rec.i + 1),
fin AS (SELECT series, a, lvl, sse, row_number() OVER (PARTITION BY series ORDER BY sse, a) AS k FROM (SELECT * FROM rec QUALIFY i = max(i) OVER (PARTITION BY series)))
SELECT series, CAST(h AS INTEGER) AS step, round(lvl, 6) AS yhat, a AS level FROM fin CROSS JOIN generate_series(1, 24) AS g(h) WHERE k = 1""")
def l8a(t):
    out = fc.smoothing_forecast(_split_x(t)[0], S, "pos", "x", "ses", 24)
    return out.select("series", "step", r("yhat").alias("yhat"), "level")


@query("l8_holt")
def l8b(t):
    return fc.smoothing_forecast(_split_x(t)[0], S, "pos", "x", "holt", 24)


@query("l8_holt_winters")
def l8c(t):
    train, test = _split_x(t)
    return sc.accuracy(_scored(fc.smoothing_forecast(train, S, "pos", "x", "holt_winters", TEST_HOURS, m=24), test), S, "x", "yhat")


@query("l9_autoregression")
def l9(t):
    train, test = _split_x(t)
    return sc.accuracy(_scored(fc.ar_forecast(train, S, "pos", "x", 6, TEST_HOURS, d=0, seasonal_d=1, m=24), test), S, "x", "yhat")


@query("l9_first_order_forecast", f"""WITH {SQL_PREDICTIONS}, tr AS (SELECT series, pos, x, lag(x) OVER (PARTITION BY series ORDER BY pos) AS x1 FROM preds WHERE part = 'train' AND x IS NOT NULL),
f AS (SELECT series, count(*) AS n, regr_slope(x, x1) AS phi, regr_intercept(x, x1) AS c, regr_syy(x, x1) AS s0, regr_syy(x, x1) - pow(regr_sxy(x, x1), 2) / regr_sxx(x, x1) AS s1, avg(x) AS m FROM tr WHERE x1 IS NOT NULL GROUP BY 1),
k AS (SELECT series, CAST(n * ln(s1 / n) + 6 < n * ln(s0 / n) + 4 AS INTEGER) AS p, n, phi, c, s0, s1, m FROM f),
g AS (SELECT series, p, CASE WHEN p = 1 THEN phi ELSE 0 END AS a, CASE WHEN p = 1 THEN c ELSE m END AS c, CASE WHEN p = 1 THEN s1 / (n - 2) ELSE s0 / (n - 1) END AS s2 FROM k),
l AS (SELECT series, max_by(x, pos) AS y FROM tr GROUP BY 1)
SELECT series, CAST(h AS INTEGER) AS step, p AS "order", round(c * (1 - pow(a, h)) / (1 - a) + pow(a, h) * y, 6) AS yhat, round(sqrt(s2 * (1 - pow(a * a, h)) / (1 - a * a)), 6) AS sigma FROM g JOIN l USING (series) CROSS JOIN generate_series(1, 12) AS t(h)""")
def l9f(t):
    out = fc.ar_forecast(_split_x(t)[0], S, "pos", "x", 1, 12)
    return out.select("series", "step", "order", r("yhat").alias("yhat"), r("sigma").alias("sigma"))


@query("l9_seasonal_arma")
def l9m(t):
    train, test = _split_x(t)
    out = arma.arma_forecast(train, S, "pos", "x", TEST_HOURS, p=1, q=1, seasonal_d=1, m=24, seasonal_q=1)
    return sc.accuracy(_scored(out, test), S, "x", "yhat")


_MA = f"""{SQL_PREDICTIONS}, tr AS (SELECT series, pos, x, lag(x) OVER w AS x1 FROM preds WHERE part = 'train' AND x IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY pos)),
f AS (SELECT series, regr_slope(x, x1) AS b, regr_intercept(x, x1) AS a FROM tr WHERE x1 IS NOT NULL GROUP BY 1),
e AS (SELECT series, pos, x, lag(x - a - b * x1) OVER (PARTITION BY series ORDER BY pos) AS e1 FROM tr JOIN f USING (series)),
g AS (SELECT series, regr_slope(x, e1) AS th, regr_intercept(x, e1) AS c, (regr_syy(x, e1) - pow(regr_sxy(x, e1), 2) / regr_sxx(x, e1)) / (count(e1) - 2) AS s2 FROM e WHERE e1 IS NOT NULL GROUP BY 1),
z AS (SELECT *, max(pos) OVER (PARTITION BY series) AS last FROM tr),
k AS (SELECT series, any_value(c) AS c, any_value(th) AS th, any_value(s2) AS s2, any_value(last) AS last, sum((x - c) * pow(-th, last - pos)) AS en
      FROM z JOIN g USING (series) WHERE pos > last - {arma.TAIL} GROUP BY 1),
fc AS (SELECT series, CAST(h AS INTEGER) AS step, last + h AS pos, c + CASE WHEN h = 1 THEN th * en ELSE 0 END AS yhat, sqrt(s2 * CASE WHEN h = 1 THEN 1 ELSE 1 + th * th END) AS sigma
       FROM k CROSS JOIN generate_series(1, {{}}) AS t(h))"""


@query("l9_moving_average_forecast", f"""WITH {_MA.format(12)} SELECT series, step, round(yhat, 6) AS yhat, round(sigma, 6) AS sigma FROM fc""")
def l9ma(t):
    out = arma.arma_forecast(_split_x(t)[0], S, "pos", "x", 12, p=0, q=1, long_lags=[1], choose=False)
    return out.select("series", "step", r("yhat").alias("yhat"), r("sigma").alias("sigma"))


@query("l60_moving_average_interval", f"""WITH {_MA.format(TEST_HOURS)} SELECT series, round(avg((abs(p.x - yhat) <= 1.96 * sigma)::INTEGER), 8) AS coverage, round(avg(2 * 1.96 * sigma), 6) AS mean_width
FROM fc JOIN preds p USING (series, pos) WHERE p.x IS NOT NULL GROUP BY 1""")
def l60m(t):
    train, test = _split_x(t)
    rows = _scored(arma.arma_forecast(train, S, "pos", "x", TEST_HOURS, p=0, q=1, long_lags=[1], choose=False), test)
    out = sc.coverage(rows, S, "x", F.col("yhat") - 1.96 * F.col("sigma"), F.col("yhat") + 1.96 * F.col("sigma"))
    return out.select("series", r("coverage", 8).alias("coverage"), r("width").alias("mean_width"))


@query("l60_parametric_interval")
def l60(t):
    train, test = _split_x(t)
    rows = _scored(fc.ar_forecast(train, S, "pos", "x", 6, TEST_HOURS), test)
    return sc.coverage(rows, S, "x", F.col("yhat") - 1.96 * F.col("sigma"), F.col("yhat") + 1.96 * F.col("sigma"))


@query("l61_decomposed_forecast")
def l61(t):
    train, test = _split_x(t)
    parts = settle(decompose.multi_seasonal(train.select("series", "pos", "x"), S, "pos", "x", [24, 168]))
    out = fc.decomposed_forecast(parts, S, "pos", [("seasonal_24", 24), ("seasonal_168", 168)], "x", TEST_HOURS)
    return sc.accuracy(_scored(out, test), S, "x", "yhat")


def _harmonics(rows):
    terms = C.fourier(F.col("pos"), _ORIGIN, [(24, 3), (168, 2)])
    return rows.select("*", *[c.alias(n) for n, c in terms.items()], ((F.col("pos") - _ORIGIN) / 720).alias("trend")), [*terms, "trend"]


@query("l10_harmonic_regression")
def l10(t):
    train, test = _split_x(t)
    a, xs = _harmonics(train)
    b, _ = _harmonics(test)
    return sc.accuracy(fc.harmonic_regression(a, b, S, "x", xs)[0], S, "x", "yhat")


@query("l10_coefficient_table")
def l10c(t):
    train, test = _split_x(t)
    a, xs = _harmonics(train)
    return fc.harmonic_regression(a, _harmonics(test)[0], S, "x", xs)[1]


@query("l10_trend_regression", f"""WITH {SQL_PREDICTIONS}, f AS (SELECT series, regr_slope(x, (pos - {_ORIGIN}) / 720.0) AS b, regr_intercept(x, (pos - {_ORIGIN}) / 720.0) AS a FROM preds WHERE part = 'train' GROUP BY 1)
SELECT series, ts, round(a + b * (pos - {_ORIGIN}) / 720.0, 6) AS yhat FROM preds JOIN f USING (series) WHERE part = 'test'""")
def l10t(t):
    train, test = (p.withColumn("trend", (F.col("pos") - _ORIGIN) / 720) for p in _split_x(t))
    return fc.harmonic_regression(train, test, S, "x", ["trend"])[0].select("series", "ts", r("yhat").alias("yhat"))


@query("l11_boosted_trees")
def l11(t):
    train, test = _parts(t)
    model = fc.boosted(train, LAGS + CALENDAR, "x", rounds=10, depth=3)
    return sc.accuracy(fc.predict(model, test, LAGS + CALENDAR, floor=0.0), S, "x", "yhat")


@query("l12_recursive_forecast")
def l12(t):
    rows, _ = _split_x(t)
    feats = ["lag1", "lag2", "lag3", "rmean3", "rstd3"]
    model = fc.boosted(ft.supervised(rows, S, "pos", "x", n_lags=3, windows=(3,)), feats, "x", rounds=8, depth=3)
    return fc.recursive_forecast(model, rows, S, "pos", "x", 24, 3, (3,), feats)


@query("l13_difference_forecast_rebuild")
def l13(t):
    from tidewright.operators.grid import rebuild_level
    train, _ = _split_x(t)
    diffs = settle(look_around(train, S, "pos", {"_l": lag_of("x")}).withColumn("x", F.col("x") - F.col("_l")).filter("x IS NOT NULL").select("series", "pos", "x"))
    feats = ["lag1", "lag2", "lag3", "rmean3", "rstd3"]
    model = fc.boosted(ft.supervised(diffs, S, "pos", "x", n_lags=3, windows=(3,)), feats, "x", rounds=8, depth=3)
    steps = fc.recursive_forecast(model, diffs, S, "pos", "x", 4, 3, (3,), feats)
    last = train.groupBy("series").agg(F.max_by("x", "pos").alias("last_x"))
    return rebuild_level(steps, S, "pos", "yhat", last, "last_x", "level").select("series", "step", "level")


@query("l14_direct_horizons")
def l14(t):
    rows = settle(hourly_filled(t).filter("x IS NOT NULL"))
    return fc.direct_horizons(rows, S, "pos", "x", [1, 6, 24, 48, 72], [0, 1, 2, 24], TEST_HOURS, rounds=6, depth=3)


def _walk(t, slots):
    rows = _panel(t)
    first, last = rows.filter("part = 'test'").agg(F.min("pos"), F.max("pos")).first()
    feats = LAGS + CALENDAR
    return fc.walk_forward_blocks(rows, "pos", fc.refit_blocks(first, last, slots),
                                  lambda train: fc.boosted(train, feats, "x", rounds=5, depth=3), lambda m, part: fc.predict(m, part, feats, floor=0.0))


@query("l18_walk_forward_refit")
def l18(t):
    return sc.accuracy(_walk(t, 72), ["block"], "x", "yhat")


@query("l19_walk_forward_by_calendar")
def l19(t):
    from tidewright.functions.gridtime import position
    rows = _panel(t)
    months = rows.filter("part = 'test'").groupBy(position(F.col("ts"), "month").alias("month")).agg(F.min("pos").alias("a"), F.max("pos").alias("b")).orderBy("month").collect()
    feats = LAGS + CALENDAR
    out = fc.walk_forward_blocks(rows, "pos", [(m["a"], m["b"]) for m in months],
                                 lambda train: fc.boosted(train, feats, "x", rounds=5, depth=3), lambda m, part: fc.predict(m, part, feats, floor=0.0))
    return sc.accuracy(out, ["block"], "x", "yhat")


@query("l25_forest_quantiles")
def l25(t):
    train, test = _parts(t)
    rows = ln.forest_quantiles(train, test, LAGS + CALENDAR, "x", {"q10": 0.1, "q50": 0.5, "q90": 0.9}, trees=5, depth=4)
    return sc.quantile_reliability(rows, S, "x", {0.1: "q10", 0.5: "q50", 0.9: "q90"})


@query("l25_boosted_quantiles")
def l25b(t):
    train, test = _parts(t)
    levels = {0.1: "q10", 0.5: "q50", 0.9: "q90"}
    forest = bt.fit(train, LAGS + CALENDAR, "x", "quantile", list(levels), rounds=15, depth=3, rate=0.25)
    return sc.quantile_reliability(bt.predict(forest, test, list(levels.values())), S, "x", levels)


@query("l27_count_losses")
def l27(t):
    train, test = _parts(t)
    feats = [*LAGS, "hour"]
    out = None
    for family in ("poisson", "tweedie"):
        model = ln.count_model(train, feats, "x", family)
        part = sc.accuracy(fc.predict(model, test, feats).withColumn("model", F.lit(family)), ["model"], "x", "yhat")
        out = part if out is None else out.unionByName(part)
    return out


@query("l27_poisson_two_groups", f"""WITH {SQL_PREDICTIONS}, m AS (SELECT isodow(ts) >= 6 AS we, avg(x) AS m FROM preds WHERE part = 'train' AND x IS NOT NULL GROUP BY 1)
SELECT p.series, p.pos, round(m, 2) AS yhat FROM preds p JOIN m ON m.we = (isodow(p.ts) >= 6) WHERE part = 'test' AND x IS NOT NULL""")
def l27p(t):
    """With one yes-or-no feature the fitted means of a Poisson model with a log link are the group means."""
    train, test = (rows.withColumn("we", C.is_weekend(F.col("ts")).cast("double")) for rows in _split_x(t))
    model = ln.count_model(train, ["we"], "x", "poisson")
    return fc.predict(model, test, ["we"]).select("series", "pos", r("yhat", 2).alias("yhat"))


@query("l28_log_target")
def l28(t):
    train, test = _parts(t)
    model = fc.log_boosted(train, LAGS + CALENDAR, "x", rounds=8, depth=3)
    return sc.accuracy(fc.log_predict(model, test, LAGS + CALENDAR), S, "x", "yhat")


@query("l31_exceedance_classifier")
def l31(t):
    train, test = _parts(t)
    feats = LAGS + CALENDAR
    model = ln.classifier("boosted", "over", rounds=8, depth=3).fit(fc.assemble(train.withColumn("over", (F.col("x") > 200).cast("double")), feats))
    rows = ln.score(model, test.withColumn("over", (F.col("x") > 200).cast("double")), feats, "flag", prob="p")
    return cl.average_precision(cl.pr_curve(rows, "over", "p"))


# ------------------------------------------------------------------ cross-sectional learning
ORDER_FEATURES = ["qty", "revenue", "discount", "tax"]
GRADES = [3, 4, 5, 6, 7, 8, 9]


def _orders(t):
    """One row per order: totals of its lines; ``grade`` 3 … 9 follows the number of lines."""
    rows = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("revenue"), F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"), F.least(F.count("*") + 2, F.lit(9)).cast("int").alias("grade"))
    rows = rows.withColumn("high", (F.col("grade") >= 7).cast("double")).withColumn("code", (F.col("grade") - 3).cast("double"))
    return settle(ft.stratified(rows, "grade", "l_orderkey", test_share=0.25, n_folds=5))


def _order_parts(t):
    rows = _orders(t)
    return rows.filter("NOT is_test"), rows.filter("is_test")


def _graded(rows, pred):
    return cl.grade_report(cl.confusion(rows.withColumn("g", cl.to_grade(F.col(pred), 3, 9)), "grade", "g"))


@query("l39_fold_scores")
def l39(t):
    return ln.mean_and_spread(ln.folds_report(_orders(t), ORDER_FEATURES, "grade", "fold", lambda: ln.classifier("forest", "grade", trees=8, depth=4), 3, 9, 5),
                              ["accuracy", "macro_f1", "mae", "kappa"])


@query("l41_classifiers")
def l41(t):
    train, test = _order_parts(t)
    out = None
    for kind in ("logistic", "forest", "boosted_multi"):
        model = ln.classifier(kind, "code", rounds=3, depth=3, trees=8).fit(fc.assemble(train, ORDER_FEATURES))
        rows = ln.score(model, test, ORDER_FEATURES, "p").withColumn("p", F.col("p") + 3)
        part = _graded(rows, "p").withColumn("model", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("l41_binary_boosted")
def l41b(t):
    train, test = _order_parts(t)
    model = ln.classifier("boosted", "high", rounds=6, depth=3).fit(fc.assemble(train, ORDER_FEATURES))
    return cl.roc_auc(ln.score(model, test, ORDER_FEATURES, "flag", prob="p"), "high", "p")


@query("l41_softmax_boosted")
def l41s(t):
    train, test = _order_parts(t)
    forest = bt.fit(train, ORDER_FEATURES, "grade", "softmax", GRADES, rounds=10, depth=3, rate=0.3)
    return _graded(bt.predict_class(forest, test, "p"), "p")


@query("l43_rare_class_recall")
def l43(t):
    train, test = _order_parts(t)
    weights = cl.class_weights(train, "code").select("code", "weight")
    model = ln.classifier("forest", "code", weight="weight", trees=8, depth=4).fit(fc.assemble(attach(train, weights, ["code"], max_rows=len(GRADES)), ORDER_FEATURES))
    rows = ln.score(model, test, ORDER_FEATURES, "p").withColumn("g", cl.to_grade(F.col("p") + 3, 3, 9))
    return cl.class_recall(cl.confusion(rows, "grade", "g"))


def _regressed(t):
    train, test = _order_parts(t)
    model = fc.boosted(train, ORDER_FEATURES, "grade", rounds=8, depth=3)
    return fc.predict(model, train, ORDER_FEATURES), fc.predict(model, test, ORDER_FEATURES)


@query("l44_regress_and_round")
def l44(t):
    return _graded(_regressed(t)[1], "yhat")


@query("l45_optimised_cut_points")
def l45(t):
    train, test = _regressed(t)
    cuts = ln.best_cuts(train, "yhat", "grade", GRADES)
    return cl.grade_report(cl.confusion(ln.apply_cuts(test, "yhat", cuts, GRADES, "g"), "grade", "g"))


@query("l46_ordinal_thresholds")
def l46(t):
    train, test = _order_parts(t)
    rows = ln.ordinal_by_thresholds(train, test, ORDER_FEATURES, "grade", GRADES, lambda label: ln.classifier("logistic", label))
    return _graded(rows, "expected_grade")


@query("l49_smote")
def l49(t):
    rows = _orders(t)
    both = ln.smote_balanced(rows, "grade", "l_orderkey", ORDER_FEATURES)
    return both.groupBy("grade").agg(F.count("*").alias("n"), F.count("new_id").alias("n_new"), *[F.avg(f).alias(f) for f in ORDER_FEATURES])


@query("l49_balanced_counts", """WITH o AS (SELECT CAST(least(count(*) + 2, 9) AS INTEGER) AS grade FROM lineitem GROUP BY l_orderkey), n AS (SELECT grade, count(*) AS own FROM o GROUP BY 1)
SELECT grade, max(own) OVER () AS n, max(own) OVER () - own AS n_new FROM n""")
def l49c(t):
    both = ln.smote_balanced(_orders(t), "grade", "l_orderkey", ORDER_FEATURES)
    return both.groupBy("grade").agg(F.count("*").alias("n"), F.count("new_id").alias("n_new"))


@query("l51_calibration")
def l51(t):
    rows = _orders(t)
    scored = ln.cross_fitted_scores(rows, ORDER_FEATURES, "high", "fold", 5, lambda: ln.classifier("boosted", "high", rounds=4, depth=3))
    out = cl.calibration_error(cl.reliability(scored, "high", "raw")).withColumn("method", F.lit("raw"))
    for method in ("platt", "isotonic"):
        fitted = ln.calibrate(scored, "high", "fold", 5, method)
        out = out.unionByName(cl.calibration_error(cl.reliability(fitted, "high", "calibrated")).withColumn("method", F.lit(method)))
    return out


# ------------------------------------------------------------------ explanation
#: Each of the 24 orders of four features twice, on 48 background rows.
_PERMUTATIONS = 48


def _explained(t):
    train, test = _order_parts(t)
    model = fc.boosted(train, ORDER_FEATURES, "grade", rounds=6, depth=3)
    return model, test.select("l_orderkey", "grade", *ORDER_FEATURES), lambda df: fc.predict(model, df, ORDER_FEATURES)


@query("l53_gain_importance")
def l53(t):
    model, test, _ = _explained(t)
    return ex.gain_importance(model, ORDER_FEATURES, test)


@query("l54_permutation_importance")
def l54(t):
    _, test, predict = _explained(t)
    return ex.permutation_importance(test, "l_orderkey", ORDER_FEATURES, predict, (F.col("grade") - F.col("yhat")) ** 2, n_repeats=5)


@query("l55_partial_dependence")
def l55(t):
    _, test, predict = _explained(t)
    return ex.partial_dependence(test, {"qty": [20, 60, 100, 140, 180, 220]}, predict)


@query("l55_interaction_grid")
def l55b(t):
    _, test, predict = _explained(t)
    return ex.partial_dependence(test, {"qty": [40, 100, 160], "revenue": [50000, 200000, 350000]}, predict)


@query("l55_dependence_of_a_formula", """SELECT CAST(d AS DOUBLE) AS l_discount, round(avg(l_extendedprice * (1 - d) * (1 + l_tax)), 3) AS mean_prediction FROM lineitem CROSS JOIN (VALUES (0.0), (0.05), (0.1)) AS g(d) GROUP BY 1""")
def l55f(t):
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    out = ex.partial_dependence(t.lineitem.select("l_extendedprice", "l_discount", "l_tax"), {"l_discount": [0.0, 0.05, 0.1]}, lambda df: df.withColumn("yhat", charge))
    return out.select("l_discount", r("mean_prediction", 3).alias("mean_prediction"))


@query("l56_additive_attribution")
def l56(t):
    _, test, predict = _explained(t)
    return ex.sampled_shapley(test, "l_orderkey", ORDER_FEATURES, predict, n_permutations=_PERMUTATIONS)


@query("l56_global_attribution")
def l56g(t):
    _, test, predict = _explained(t)
    return ex.global_attribution(ex.sampled_shapley(test, "l_orderkey", ORDER_FEATURES, predict, n_permutations=_PERMUTATIONS))


@query("l56_tree_attribution")
def l56t(t):
    model, test, _ = _explained(t)
    return bt.tree_attribution(bt.from_ml(model, ORDER_FEATURES), test, "l_orderkey")


@query("l56_tree_attribution_global")
def l56tg(t):
    model, test, _ = _explained(t)
    return ex.global_attribution(bt.tree_attribution(bt.from_ml(model, ORDER_FEATURES), test, "l_orderkey"))


# ------------------------------------------------------------------ one round of one split, which SQL can state
_CUTS = {"qty": [50.5, 100.5, 150.5], "revenue": [50000.5, 150000.5, 250000.5], "discount": [0.03111, 0.05222], "tax": [0.03111, 0.04222]}
_STUMP = """o AS (SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS qty, CAST(sum(l_extendedprice) AS DOUBLE) AS revenue, avg(l_discount) AS discount, avg(l_tax) AS tax,
                     CAST(least(count(*) + 2, 9) AS DOUBLE) AS y FROM lineitem GROUP BY 1),
x AS (UNPIVOT o ON qty, revenue, discount, tax INTO NAME feature VALUE v),
c AS (SELECT * FROM (VALUES """ + ", ".join(f"('{f}', {j}, CAST({c} AS DOUBLE))" for j, (f, cs) in enumerate(_CUTS.items()) for c in cs) + ") AS t(feature, j, cut)),\n"
# needs gr (l_orderkey, k, g, h): gradients by output
_SPLITS = """s AS (SELECT k, j, feature, cut, sum(g) FILTER (v <= cut) AS gl, sum(h) FILTER (v <= cut) AS hl, count(*) FILTER (v <= cut) AS nl,
                   sum(g) FILTER (v > cut) AS gr, sum(h) FILTER (v > cut) AS hr, count(*) FILTER (v > cut) AS nr FROM gr JOIN x USING (l_orderkey) JOIN c USING (feature) GROUP BY 1, 2, 3, 4),
b AS (SELECT * FROM (SELECT *, gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) * (gl + gr) / (hl + hr + 1) AS gain FROM s WHERE nl >= 20 AND nr >= 20)
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(gain, 9) DESC, j, cut) = 1)"""
_NEWTON = """SELECT output, node, feature, cut, round(value, 8) + 0.0 AS value, cover FROM (
  SELECT k AS output, 1 AS node, feature, cut, CAST(NULL AS DOUBLE) AS value, nl + nr AS cover FROM b
  UNION ALL SELECT k, 2, NULL, NULL, 0.5 * gl / (hl + 1), nl FROM b UNION ALL SELECT k, 3, NULL, NULL, 0.5 * gr / (hr + 1), nr FROM b)"""


def _stump(t, label, loss, outputs):
    rows = _orders(t).withColumn("log_grade", F.log1p("grade"))
    forest = bt.fit(rows, ORDER_FEATURES, label, loss, outputs, rounds=1, depth=1, rate=0.5, min_rows=20, cuts=_CUTS)
    return rows, forest, forest.nodes(rows.sparkSession).select("output", "node", "feature", "cut", r("value", 8).alias("value"), "cover")


@query("l11_boosted_stump", f"""WITH {_STUMP} gr AS (SELECT l_orderkey, '0' AS k, y - avg(y) OVER () AS g, 1.0 AS h FROM o), {_SPLITS} {_NEWTON}""")
def l11s(t):
    return _stump(t, "grade", "squared", [0])[2]


@query("l41_softmax_stump", f"""WITH {_STUMP} p AS (SELECT y AS k, count(*) / sum(count(*)) OVER () AS p FROM o GROUP BY 1),
gr AS (SELECT l_orderkey, CAST(CAST(k AS INTEGER) AS VARCHAR) AS k, (y = k)::INTEGER - p AS g, p * (1 - p) AS h FROM o, p), {_SPLITS} {_NEWTON}""")
def l41st(t):
    return _stump(t, "grade", "softmax", GRADES)[2]


@query("l25_quantile_stump", f"""WITH {_STUMP} q AS (SELECT 0.3 AS p, quantile_disc(y, 0.3) AS f FROM o UNION ALL SELECT 0.6, quantile_disc(y, 0.6) FROM o),
gr AS (SELECT l_orderkey, CAST(p AS VARCHAR) AS k, CASE WHEN y > f THEN p ELSE p - 1 END AS g, 1.0 AS h, y - f AS res FROM o, q), {_SPLITS},
lf AS (SELECT k, node, count(*) AS cover, CASE WHEN k = '0.3' THEN quantile_disc(res, 0.3) ELSE quantile_disc(res, 0.6) END AS q FROM
         (SELECT b.k, gr.res, CASE WHEN x.v > b.cut THEN 3 ELSE 2 END AS node FROM b JOIN gr USING (k) JOIN x ON x.l_orderkey = gr.l_orderkey AND x.feature = b.feature) GROUP BY 1, 2)
SELECT k AS output, 1 AS node, feature, cut, CAST(NULL AS DOUBLE) AS value, nl + nr AS cover FROM b UNION ALL SELECT k, node, NULL, NULL, round(0.5 * q, 8) + 0.0, cover FROM lf""")
def l25s(t):
    return _stump(t, "grade", "quantile", [0.3, 0.6])[2]


_PREDICTED = """ft AS (SELECT o.l_orderkey, o.y, (SELECT avg({y}) FROM o) + 0.5 * CASE WHEN x.v > b.cut THEN gr / (hr + 1) ELSE gl / (hl + 1) END AS yhat
       FROM o JOIN x USING (l_orderkey) JOIN b ON b.feature = x.feature)"""


@query("l28_log_target_stump", f"""WITH {_STUMP} gr AS (SELECT l_orderkey, '0' AS k, ln(1 + y) - avg(ln(1 + y)) OVER () AS g, 1.0 AS h FROM o), {_SPLITS}, {_PREDICTED.format(y="ln(1 + y)")}
SELECT l_orderkey, round(exp(yhat) - 1, 8) AS yhat FROM ft""")
def l28s(t):
    rows, forest, _ = _stump(t, "log_grade", "squared", [0])
    return bt.predict(forest, rows, ["yhat"]).select("l_orderkey", r(F.expm1("yhat"), 8).alias("yhat"))


@query("l44_rounded_stump", f"""WITH {_STUMP} gr AS (SELECT l_orderkey, '0' AS k, y - avg(y) OVER () AS g, 1.0 AS h FROM o), {_SPLITS}, {_PREDICTED.format(y="y")}
SELECT CAST(y AS INTEGER) AS grade, CAST(greatest(3, least(9, round(yhat))) AS INTEGER) AS predicted, count(*) AS n FROM ft GROUP BY 1, 2""")
def l44s(t):
    rows, forest, _ = _stump(t, "grade", "squared", [0])
    out = bt.predict(forest, rows, ["yhat"]).withColumn("predicted", cl.to_grade(F.col("yhat"), 3, 9).cast("int"))
    return out.groupBy("grade", "predicted").agg(F.count("*").alias("n"))


@query("l56_stump_attribution", f"""WITH {_STUMP} gr AS (SELECT l_orderkey, '0' AS k, y - avg(y) OVER () AS g, 1.0 AS h FROM o), {_SPLITS},
m AS (SELECT feature, cut, 0.5 * gl / (hl + 1) AS lo, 0.5 * gr / (hr + 1) AS hi, nl, nr FROM b),
a AS (SELECT l_orderkey, x.feature, v, CASE WHEN x.feature <> m.feature THEN 0.0 ELSE (CASE WHEN v > cut THEN hi ELSE lo END) - (lo * nl + hi * nr) / (nl + nr) END AS a, (lo * nl + hi * nr) / (nl + nr) AS mean FROM x, m)
SELECT l_orderkey, feature, round(a, 8) + 0.0 AS attribution, round(sum(a) OVER (PARTITION BY l_orderkey) + mean + (SELECT avg(y) FROM o), 8) AS yhat FROM a""")
def l56s(t):
    rows, forest, _ = _stump(t, "grade", "squared", [0])
    return bt.tree_attribution(forest, rows, "l_orderkey").select("l_orderkey", "feature", r("attribution", 8).alias("attribution"), r("yhat", 8).alias("yhat"))


# ------------------------------------------------------------------ scenarios
_SD = {"lag_24": 15.0, "roll24": 8.0}


def _scenario_setup(t, n):
    train, test = _parts(t)
    model = fc.boosted(train, LAGS + CALENDAR, "x", rounds=6, depth=3)
    rows = sim.scenarios(test.select("series", "pos", "x", *LAGS, *CALENDAR), S, "pos", _SD, n, seed=5)
    return model, train, test, rows


@query("l32_perturbed_inputs")
def l32(t):
    _, _, test, rows = _scenario_setup(t, 200)
    base = test.select("series", "pos", F.col("lag_24").alias("base"))
    return rows.join(base, ["series", "pos"]).groupBy("series").agg(F.count("*").alias("n"), F.stddev_pop(F.col("lag_24") - F.col("base")).alias("noise_sd"))


@query("l33_scenario_fan")
def l33(t):
    model, _, _, rows = _scenario_setup(t, 200)
    out = sim.fan(rows, lambda df: fc.predict(model, df, LAGS + CALENDAR, floor=0.0), S, "pos", "yhat", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return out.select("series", slot_start(F.col("pos"), "hour").alias("ts"), "n_scenarios", "spread", "p05", "p50", "p95")
