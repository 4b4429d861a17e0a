"""Queries: supervised tables, splits, baselines, forecast scores, intervals, classification scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import columns as C
from tidewright.functions.gridtime import floor_to
from tidewright.operators import classify as cl, features as ft, grid, scoring as sc
from tidewright.operators.ordering import attach, lag_of, look_around, rolling, sorted_scan
from tidewright.plans.panels import S, SQL_FILLED, SQL_PREDICTIONS, TEST_HOURS, hourly_filled, predictions, r
from tidewright.functions.holidays import holiday_table, us_holidays
from tidewright.plans.registry import query
from tidewright.session import settle

_W = "WINDOW w AS (PARTITION BY series ORDER BY pos)"


@query("l1_supervised_table", f"""WITH {SQL_FILLED}, s AS (SELECT series, ts, x, CAST(month(ts) AS INTEGER) AS month, lag(x, 1) OVER w AS lag1, lag(x, 2) OVER w AS lag2, lag(x, 3) OVER w AS lag3,
CASE WHEN count(x) OVER f = 6 THEN round(avg(x) OVER f, 8) END AS rmean6, CASE WHEN count(x) OVER f = 6 THEN round(stddev_samp(x) OVER f, 5) END AS rstd6 FROM filled
WINDOW w AS (PARTITION BY series ORDER BY pos), f AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT * FROM s WHERE rmean6 IS NOT NULL AND lag3 IS NOT NULL AND x IS NOT NULL""")
def l1(t):
    rows = ft.supervised(hourly_filled(t), S, "pos", "x", "ts", n_lags=3, windows=(6,))
    return rows.select("series", "ts", "x", "month", "lag1", "lag2", "lag3", r("rmean6", 8).alias("rmean6"), r("rstd6", 5).alias("rstd6"))


@query("l2_horizon_safe_features", f"""WITH {SQL_FILLED} SELECT series, ts, lag(x, 24) OVER w AS lag_24, lag(x, 168) OVER w AS lag_168,
CASE WHEN count(x) OVER f = 24 THEN round(avg(x) OVER f, 7) END AS dayavg FROM filled WINDOW w AS (PARTITION BY series ORDER BY pos), f AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING)""")
def l2(t):
    rows = ft.horizon_safe(hourly_filled(t), S, "pos", "x", 24, [24, 168], [("dayavg", 24, 24)])
    return rows.select("series", "ts", "lag_24", "lag_168", r("dayavg", 7).alias("dayavg"))


_O = 473352


@query("l2_forecast_features", f"""WITH {SQL_FILLED} SELECT series, ts, lag(x, 24) OVER w AS lag_24, lag(x, 25) OVER w AS lag_25, lag(x, 48) OVER w AS lag_48, lag(x, 192) OVER w AS lag_192,
CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dow, round(sin(2 * pi() * (pos - {_O}) / 8766), 7) + 0.0 AS s1, round(cos(6 * pi() * (pos - {_O}) / 8766), 7) + 0.0 AS c3,
CAST(CAST(ts AS DATE) IN ({", ".join(f"DATE '{d}'" for d in sorted({d for d, _ in us_holidays(1980, 2040)}))}) AS INTEGER) AS is_holiday FROM filled {_W}""")
def l2f(t):
    rows = hourly_filled(t)
    span = rows.agg(F.year(F.min("ts")).alias("a"), F.year(F.max("ts")).alias("b")).first()
    days = holiday_table(t.spark, span["a"] or 2000, span["b"] or 2000)
    rows = ft.forecast_features(rows, S, "pos", "ts", "x", 24, _O, holidays=days)
    return rows.select("series", "ts", "lag_24", "lag_25", "lag_48", "lag_192", "hour", "dow", r("sin_8766_1", 7).alias("s1"), r("cos_8766_3", 7).alias("c3"), "is_holiday")


@query("l3_leak_demonstration", f"""WITH {SQL_FILLED}, f AS (SELECT series, x, avg(x) OVER a AS leaky, count(x) OVER a AS ka, avg(x) OVER b AS safe, count(x) OVER b AS kb FROM filled
WINDOW a AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT series, round(corr(x, CASE WHEN ka = 3 THEN leaky END), 7) + 0.0 AS leaky_corr, round(corr(x, CASE WHEN kb = 3 THEN safe END), 7) + 0.0 AS safe_corr FROM f GROUP BY 1""")
def l3(t):
    rows = look_around(hourly_filled(t), S, "pos", {"leaky": rolling("mean", "x", 3), "safe": rolling("mean", "x", 3, 1)})
    return rows.groupBy("series").agg(r(F.corr("x", "leaky"), 7).alias("leaky_corr"), r(F.corr("x", "safe"), 7).alias("safe_corr"))


@query("l4_time_split", f"""WITH {SQL_PREDICTIONS} SELECT series, part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM preds GROUP BY 1, 2""")
def l4(t):
    rows = ft.split_last(hourly_filled(t), S, "pos", TEST_HOURS)
    return rows.groupBy("series", "part").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("l4_three_way_split", """SELECT CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-07-01' THEN 'calibrate' ELSE 'test' END AS part,
count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1""")
def l4b(t):
    rows = ft.split_dates(t.orders, "o_orderdate", "1999-01-01 00:00:00", "2000-07-01 00:00:00")
    return rows.groupBy("part").agg(F.count("*").alias("n"), r(F.avg("o_totalprice"), 4).alias("mean_price"))


_FOLDS = SQL_FILLED + """, ix AS (SELECT series, ts, row_number() OVER (PARTITION BY series ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM filled),
fd AS (SELECT series, ts, CAST(k AS INTEGER) AS fold, i, n - (5 - k) * 24 AS st, n - 5 * 24 AS width FROM ix CROSS JOIN generate_series(0, 4) AS g(k))"""


@query("l5_expanding_folds", f"""WITH {_FOLDS}, q AS (SELECT *, CASE WHEN i >= st AND i < st + 24 THEN 'test' WHEN i < st - 6 THEN 'train' END AS role FROM fd)
SELECT series, fold, role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM q WHERE role IS NOT NULL GROUP BY 1, 2, 3""")
def l5(t):
    rows = ft.folds(hourly_filled(t), S, "pos", 5, 24, gap=6)
    return rows.groupBy("series", "fold", "role").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("l5_sliding_folds", f"""WITH {_FOLDS}, q AS (SELECT *, CASE WHEN i >= st AND i < st + 24 THEN 'test' WHEN i < st AND i >= greatest(0, st - width) THEN 'train' END AS role FROM fd)
SELECT series, fold, role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM q WHERE role IS NOT NULL GROUP BY 1, 2, 3""")
def l5s(t):
    rows = ft.folds(hourly_filled(t), S, "pos", 5, 24, mode="sliding")
    return rows.groupBy("series", "fold", "role").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_TRAIN = SQL_PREDICTIONS + """, tr AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY pos) AS i, row_number() OVER (PARTITION BY series ORDER BY pos DESC) AS j FROM preds WHERE part = 'train'),
en AS (SELECT series, max(x) FILTER (i = 1) AS f, max(x) FILTER (j = 1) AS l, avg(x) AS m, count(*) AS n FROM tr GROUP BY 1),
bl AS (SELECT en.series, CAST(k AS INTEGER) AS step, l, f, m, en.n, s.x AS sx FROM en CROSS JOIN generate_series(1, 48) AS g(k) JOIN tr s ON s.series = en.series AND s.j = 24 - (k - 1) % 24)"""


@query("l6_baseline_forecasts", f"""WITH {_TRAIN} SELECT series, step, 'naive' AS model, round(l, 6) AS yhat FROM bl UNION ALL SELECT series, step, 'seasonal_naive', round(sx, 6) FROM bl
UNION ALL SELECT series, step, 'drift', round(l + (l - f) / (n - 1) * step, 6) FROM bl UNION ALL SELECT series, step, 'mean', round(m, 6) FROM bl""")
def l6(t):
    train = settle(predictions(t).filter("part = 'train'").select("series", "pos", "x"))
    return sc.baselines(train, S, "pos", "x", 48, 24).select("series", "step", "model", r("yhat").alias("yhat"))


@query("l7_climatology_forecast", f"""WITH {SQL_PREDICTIONS}, c AS (SELECT series, isodow(ts) >= 6 AS we, hour(ts) AS h, avg(x) AS m FROM preds WHERE part = 'train' GROUP BY 1, 2, 3)
SELECT p.series, p.ts, round(m, 6) AS yhat FROM preds p LEFT JOIN c ON c.series = p.series AND c.we = (isodow(p.ts) >= 6) AND c.h = hour(p.ts) WHERE part = 'test'""")
def l7(t):
    rows = settle(predictions(t).withColumn("we", C.is_weekend(F.col("ts"))).withColumn("h", F.hour("ts")))
    out = sc.climatology_forecast(rows.filter("part = 'train'"), rows.filter("part = 'test'").select("series", "ts", "we", "h"), S, "x", ["we", "h"])
    return out.select("series", "ts", r("yhat").alias("yhat"))


@query("l13_rebuilt_level", f"""WITH {SQL_PREDICTIONS}, d AS (SELECT series, ts, pos, part, x, x - lag(x) OVER (PARTITION BY series ORDER BY pos) AS dx FROM preds),
b AS (SELECT series, max_by(x, pos) AS l FROM preds WHERE part = 'train' GROUP BY 1)
SELECT d.series, d.ts, round(l + sum(dx) OVER (PARTITION BY d.series ORDER BY pos), 5) + 0.0 AS level FROM d JOIN b USING (series) WHERE part = 'test'""")
def l13(t):
    rows = settle(look_around(predictions(t), S, "pos", {"_l": lag_of("x")}).withColumn("dx", F.col("x") - F.col("_l")))
    last = rows.filter("part = 'train'").groupBy("series").agg(F.max_by("x", "pos").alias("last_x"))
    out = grid.rebuild_level(rows.filter("part = 'test'").select("series", "pos", "ts", "dx"), S, "pos", "dx", last, "last_x", "level")
    return out.select("series", "ts", r("level", 5).alias("level"))


# ------------------------------------------------------------------ forecast scores
_LONG = SQL_PREDICTIONS + """, lg AS (SELECT series, ts, pos, x, 'naive_day' AS model, p24 AS yhat FROM preds WHERE part = 'test' UNION ALL SELECT series, ts, pos, x, 'naive_week', p168 FROM preds WHERE part = 'test'),
scl AS (SELECT series, avg(abs(x - p24)) AS scale FROM preds WHERE part = 'train' GROUP BY 1)"""


def _long(t):
    rows = settle(predictions(t))
    long = rows.filter("part = 'test'").select("series", "ts", "pos", "x", F.inline(F.array(
        F.struct(F.lit("naive_day").alias("model"), F.col("p24").alias("yhat")), F.struct(F.lit("naive_week").alias("model"), F.col("p168").alias("yhat")))))
    return rows, long


@query("l15_forecast_metrics", f"""WITH {_LONG} SELECT model, count(abs(x - yhat)) AS n, round(avg(abs(x - yhat)), 6) AS mae, round(sqrt(avg(pow(x - yhat, 2))), 6) AS rmse,
round(100 * avg(abs(x - yhat) / nullif(abs(x), 0)), 5) AS mape, round(100 * avg(2 * abs(x - yhat) / nullif(abs(x) + abs(yhat), 0)), 5) AS smape, round(100 * sum(abs(x - yhat)) / sum(abs(x)) FILTER (yhat IS NOT NULL), 5) AS wape FROM lg GROUP BY 1""")
def l15(t):
    a = sc.accuracy(_long(t)[1], ["model"], "x", "yhat")
    return a.select("model", "n", r("mae").alias("mae"), r("rmse").alias("rmse"), *[r(c, 5).alias(c) for c in ("mape", "smape", "wape")])


@query("l16_leaderboard", f"""WITH {_LONG} SELECT series, model, count(abs(x - yhat)) AS n, round(avg(abs(x - yhat)), 6) AS mae, round(sqrt(avg(pow(x - yhat, 2))), 6) AS rmse,
round(100 * sum(abs(x - yhat)) / sum(abs(x)) FILTER (yhat IS NOT NULL), 5) AS wape, round(avg(abs(x - yhat)) / any_value(scale), 6) AS mase FROM lg JOIN scl USING (series) GROUP BY 1, 2""")
def l16(t):
    rows, long = _long(t)
    scale = sc.naive_scale(rows.filter("part = 'train'"), S, "pos", "x", 24)
    b = sc.leaderboard(long, "x", "yhat", scale, S)
    return b.select("series", "model", "n", r("mae").alias("mae"), r("rmse").alias("rmse"), r("wape", 5).alias("wape"), r("mase").alias("mase"))


@query("l17_walk_forward", f"""WITH {SQL_FILLED}, w AS (SELECT series, x, lag(x) OVER o AS l, lag(x, 24) OVER o AS s, row_number() OVER o AS i, sum(x) OVER o - x AS sm, first_value(x) OVER o AS f FROM filled WINDOW o AS (PARTITION BY series ORDER BY pos)),
lg AS (SELECT series, x, 'naive' AS model, l AS yhat FROM w WHERE i > 336 UNION ALL SELECT series, x, 'seasonal_naive', s FROM w WHERE i > 336
UNION ALL SELECT series, x, 'mean', sm / (i - 1) FROM w WHERE i > 336 UNION ALL SELECT series, x, 'drift', l + (l - f) / (i - 2) FROM w WHERE i > 336)
SELECT series, model, count(*) AS n, round(avg(abs(x - yhat)), 6) AS mae FROM lg GROUP BY 1, 2""")
def l17(t):
    walk = sc.one_step_walk(hourly_filled(t), S, "pos", "x", 24, 336)
    return walk.groupBy("series", "model").agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("y") - F.col("yhat")))).alias("mae"))


@query("l20_error_by_day_and_hour", f"""WITH {_LONG} SELECT model, date_trunc('day', ts) AS day, count(*) AS n, round(avg(abs(x - yhat)), 6) AS mae,
round(max(x) - max(yhat), 6) + 0.0 AS peak_error FROM lg GROUP BY 1, 2""")
def l20(t):
    long = _long(t)[1]
    return long.groupBy("model", floor_to(F.col("ts"), "day").alias("day")).agg(
        F.count("*").alias("n"), r(F.avg(F.abs(F.col("x") - F.col("yhat")))).alias("mae"), r(F.max("x") - F.max("yhat")).alias("peak_error"))


@query("l20_worst_hour", f"""WITH {_LONG}, h AS (SELECT model, CAST(hour(ts) AS INTEGER) AS hour, round(avg(abs(x - yhat)), 6) AS mae FROM lg GROUP BY 1, 2)
SELECT model, arg_max(hour, mae * 1000 - hour * 1e-9) AS worst_hour, max(mae) AS worst_mae FROM h GROUP BY 1""")
def l20w(t):
    h = _long(t)[1].groupBy("model", F.hour("ts").alias("hour")).agg(r(F.avg(F.abs(F.col("x") - F.col("yhat")))).alias("mae"))
    return h.groupBy("model").agg(F.max_by("hour", F.struct("mae", -F.col("hour"))).alias("worst_hour"), F.max("mae").alias("worst_mae"))


# ------------------------------------------------------------------ intervals
_CAL = SQL_PREDICTIONS + """, ca AS (SELECT series, x, p24, p168, pos > max(pos) OVER (PARTITION BY series) - 168 AS late FROM preds WHERE p168 IS NOT NULL AND p24 IS NOT NULL),
os AS (SELECT series, e, row_number() OVER (PARTITION BY series ORDER BY e) AS k, count(*) OVER (PARTITION BY series) AS n FROM (SELECT series, abs(x - p24) AS e FROM ca WHERE NOT late))"""


def _calibrated(t):
    rows = settle(predictions(t).filter("p168 IS NOT NULL AND p24 IS NOT NULL"))
    return rows.filter("part = 'train'"), rows.filter("part = 'test'")


@query("l21_conformal_radius", f"""WITH {_CAL} SELECT series, round(max(e) FILTER (k = least(ceil((n + 1) * 0.9), n)), 6) AS radius, round(quantile_cont(e, 0.9), 6) AS plain_radius FROM os GROUP BY 1""")
def l21(t):
    train, _ = _calibrated(t)
    a = sc.conformal_radius(train, S, "x", "p24")
    b = sc.conformal_radius(train, S, "x", "p24", finite_sample=False).withColumnRenamed("radius", "plain_radius")
    return a.join(b, "series").select("series", r("radius").alias("radius"), r("plain_radius").alias("plain_radius"))


@query("l22_coverage_and_width", f"""WITH {_CAL}, rd AS (SELECT series, max(e) FILTER (k = least(ceil((n + 1) * 0.9), n)) AS q FROM os GROUP BY 1)
SELECT series, count(*) AS n, round(avg((x BETWEEN p24 - q AND p24 + q)::INTEGER), 7) AS coverage, round(avg(2 * q), 5) AS width FROM ca JOIN rd USING (series) WHERE late GROUP BY 1""")
def l22(t):
    train, test = _calibrated(t)
    rows = attach(test, sc.conformal_radius(train, S, "x", "p24"), S)
    c = sc.coverage(rows, S, "x", F.col("p24") - F.col("radius"), F.col("p24") + F.col("radius"))
    return c.select("series", "n", r("coverage", 7).alias("coverage"), r("width", 5).alias("width"))


@query("l23_pinball", f"""WITH {_CAL} SELECT series, round(avg(greatest(0.1 * (x - least(p24, p168)), -0.9 * (x - least(p24, p168)))), 7) AS low_loss,
round(avg(greatest(0.9 * (x - greatest(p24, p168)), -0.1 * (x - greatest(p24, p168)))), 7) AS high_loss FROM ca GROUP BY 1""")
def l23(t):
    rows = predictions(t).filter("p168 IS NOT NULL AND p24 IS NOT NULL").withColumn("lo", F.least("p24", "p168")).withColumn("hi", F.greatest("p24", "p168"))
    return rows.groupBy("series").agg(r(sc.pinball("x", "lo", 0.1), 7).alias("low_loss"), r(sc.pinball("x", "hi", 0.9), 7).alias("high_loss"))


@query("l24_cqr_offset", f"""WITH {_CAL}, e AS (SELECT series, greatest(least(p24, p168) - x, x - greatest(p24, p168)) AS e FROM ca WHERE NOT late),
k AS (SELECT series, e, row_number() OVER (PARTITION BY series ORDER BY e) AS k, count(*) OVER (PARTITION BY series) AS n FROM e)
SELECT series, round(max(e) FILTER (k = least(ceil((n + 1) * 0.8), n)), 6) + 0.0 AS "offset", round(quantile_cont(e, 0.8), 6) + 0.0 AS plain_offset FROM k GROUP BY 1""")
def l24(t):
    train = settle(_calibrated(t)[0].withColumn("lo", F.least("p24", "p168")).withColumn("hi", F.greatest("p24", "p168")))
    a = sc.cqr_offset(train, S, "x", "lo", "hi", 0.2)
    b = sc.cqr_offset(train, S, "x", "lo", "hi", 0.2, finite_sample=False).withColumnRenamed("offset", "plain_offset")
    return a.join(b, "series").select("series", r("offset").alias("offset"), r("plain_offset").alias("plain_offset"))


@query("l26_quantile_reliability", f"""WITH {_CAL}, lv AS (SELECT series, x, 0.25::DOUBLE AS level, least(p24, p168) AS q FROM ca UNION ALL SELECT series, x, 0.5::DOUBLE, (p24 + p168) / 2 FROM ca UNION ALL SELECT series, x, 0.75::DOUBLE, greatest(p24, p168) FROM ca)
SELECT series, level, round(avg((x <= q)::INTEGER), 7) AS observed, round(avg(greatest(level * (x - q), (level - 1) * (x - q))), 7) AS pinball FROM lv GROUP BY 1, 2""")
def l26(t):
    rows = predictions(t).filter("p168 IS NOT NULL AND p24 IS NOT NULL").select(
        "series", "x", F.least("p24", "p168").alias("a"), ((F.col("p24") + F.col("p168")) / 2).alias("b"), F.greatest("p24", "p168").alias("c"))
    out = sc.quantile_reliability(rows, S, "x", {0.25: "a", 0.5: "b", 0.75: "c"})
    return out.select("series", "level", r("observed", 7).alias("observed"), r("pinball", 7).alias("pinball"))


@query("l29_tail_bias", f"""WITH {_LONG} SELECT model, CAST(th AS DOUBLE) AS threshold, count(*) FILTER (x > th) AS n, round(avg(x) FILTER (x > th), 6) AS mean_actual, round(avg(yhat) FILTER (x > th), 6) AS mean_predicted
FROM lg CROSS JOIN (VALUES (150.0), (250.0), (400.0)) AS v(th) GROUP BY 1, 2""")
def l29(t):
    out = sc.tail_bias(_long(t)[1], ["model"], "x", "yhat", [150.0, 250.0, 400.0])
    return out.select("model", "threshold", "n", r("mean_actual").alias("mean_actual"), r("mean_predicted").alias("mean_predicted"))


@query("l30_exceedance_warning", f"""WITH {_LONG}, c AS (SELECT model, count(*) FILTER (x > 200 AND yhat > 200) AS tp, count(*) FILTER (x <= 200 AND yhat > 200) AS fp, count(*) FILTER (x > 200 AND yhat <= 200) AS fn,
count(*) FILTER (x <= 200 AND yhat <= 200) AS tn FROM lg GROUP BY 1)
SELECT *, round(tp / nullif(tp + fp, 0), 7) AS "precision", round(tp / nullif(tp + fn, 0), 7) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 7) AS f1 FROM c""")
def l30(t):
    out = sc.exceedance(_long(t)[1], ["model"], "x", "yhat", 200.0)
    return out.select("model", "tp", "fp", "fn", "tn", *[r(c, 7).alias(c) for c in ("precision", "recall", "f1")])


@query("l34_interval_stack", f"""WITH {_CAL}, v AS (SELECT series, var_samp(x - p24) AS model_var, var_samp((p24 - p168) / 2) AS input_var FROM ca WHERE NOT late GROUP BY 1)
SELECT series, count(*) AS n, round(any_value(input_var / (input_var + model_var)), 7) AS input_share, round(avg((abs(x - p24) <= 1.645 * sqrt(model_var + input_var))::INTEGER), 7) AS coverage FROM ca JOIN v USING (series) WHERE late GROUP BY 1""")
def l34(t):
    from tidewright.operators.simulate import stacked_interval, variance_split
    train, test = _calibrated(t)
    parts = variance_split(train, S, F.col("x") - F.col("p24"), (F.col("p24") - F.col("p168")) / 2)
    rows = stacked_interval(attach(test, parts, S), "p24", 1.645)
    share = F.max(F.col("input_var") / (F.col("input_var") + F.col("model_var")))
    return rows.groupBy("series").agg(F.count("*").alias("n"), r(share, 7).alias("input_share"),
                                      r(F.avg(F.col("x").between(F.col("lo"), F.col("hi")).cast("int")), 7).alias("coverage"))


# ------------------------------------------------------------------ classification scores
@query("l35_stratified_split", """WITH k AS (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY ((id % 1000003) * 2654435761) % 1000003, id) AS p, count(*) OVER (PARTITION BY l_returnflag) AS m
FROM (SELECT l_returnflag, o_orderkey * 8 + 1 AS id FROM orders JOIN (SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey))
SELECT l_returnflag, CAST((p - 1) % 5 AS INTEGER) AS fold, count(*) AS n, count(*) FILTER (p <= floor(m * 0.25 + 0.5)) AS n_test FROM k GROUP BY 1, 2""")
def l35(t):
    flags = t.lineitem.groupBy("l_orderkey").agg(F.min("l_returnflag").alias("l_returnflag"))
    rows = t.orders.join(flags, F.col("o_orderkey") == F.col("l_orderkey")).select("l_returnflag", (F.col("o_orderkey") * 8 + 1).alias("id"))
    out = ft.stratified(rows, "l_returnflag", "id", test_share=0.25, n_folds=5)
    return out.groupBy("l_returnflag", "fold").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


_GRADED = "SELECT l_returnflag, l_linenumber AS actual, CAST(least(greatest(round_even(l_quantity * 6 / 50 + 1, 0), 1), 7) AS INTEGER) AS predicted FROM lineitem"


def _graded(t):
    return t.lineitem.select("l_returnflag", F.col("l_linenumber").alias("actual"), cl.to_grade(F.col("l_quantity") * 6 / 50 + 1, 1, 7).alias("predicted"))


@query("l37_grade_report", f"""WITH g AS ({_GRADED}), k AS (SELECT unnest(range(1, 8)) AS c), f AS (SELECT c, count(*) FILTER (actual = c AND predicted = c) AS tp, count(*) FILTER (actual = c) AS s, count(*) FILTER (predicted = c) AS p FROM g, k GROUP BY 1)
SELECT count(*) AS n, round(avg((actual = predicted)::INTEGER), 8) AS accuracy, round((SELECT avg(2 * tp / (s + p)) FROM f WHERE s + p > 0), 8) AS macro_f1, round(avg(abs(actual - predicted)), 8) AS mae FROM g""")
def l37(t):
    rep = cl.grade_report(cl.confusion(_graded(t), "actual", "predicted"))
    return rep.select("n", *[r(c, 8).alias(c) for c in ("accuracy", "macro_f1", "mae")])


@query("l38_quadratic_kappa", f"""WITH g AS ({_GRADED}), o AS (SELECT l_returnflag, avg(pow(actual - predicted, 2)) AS d FROM g GROUP BY 1),
a AS (SELECT l_returnflag, actual, count(*)::DOUBLE AS k FROM g GROUP BY 1, 2), p AS (SELECT l_returnflag, predicted, count(*)::DOUBLE AS k FROM g GROUP BY 1, 2), n AS (SELECT l_returnflag, count(*)::DOUBLE AS n FROM g GROUP BY 1),
e AS (SELECT a.l_returnflag, sum(a.k * p.k * pow(actual - predicted, 2)) / any_value(n * n) AS d FROM a JOIN p ON a.l_returnflag = p.l_returnflag JOIN n ON n.l_returnflag = a.l_returnflag GROUP BY 1)
SELECT l_returnflag, round(1 - o.d / e.d, 7) + 0.0 AS kappa FROM o JOIN e USING (l_returnflag)""")
def l38(t):
    rep = cl.grade_report(cl.confusion(_graded(t), "actual", "predicted", ["l_returnflag"]), ["l_returnflag"])
    return rep.select("l_returnflag", r("kappa", 7).alias("kappa"))


@query("l40_majority_baseline", """WITH c AS (SELECT l_linenumber AS g, count(*) AS n FROM lineitem GROUP BY 1) SELECT max_by(g, n * 10 - g) AS majority, round(max(n) / sum(n), 8) AS accuracy FROM c""")
def l40(t):
    top = cl.majority_class(t.lineitem, "l_linenumber")
    return attach(t.lineitem.select("l_linenumber"), top).groupBy("majority").agg(r(F.avg((F.col("l_linenumber") == F.col("majority")).cast("int")), 8).alias("accuracy"))


@query("l40_random_baseline")
def l40r(t):
    rows = t.lineitem.withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber")).select("id", "l_linenumber")
    out = cl.random_class(rows, rows, "l_linenumber", "id", "drawn", seed=3)
    return cl.grade_report(cl.confusion(out, "l_linenumber", "drawn"))


@query("l42_confusion", f"""WITH g AS ({_GRADED}) SELECT actual, predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY actual), 8) AS share FROM g GROUP BY 1, 2""")
def l42(t):
    return cl.confusion_shares(cl.confusion(_graded(t), "actual", "predicted")).withColumn("share", r("share", 8))


@query("l42_within_one", f"WITH g AS ({_GRADED}) SELECT count(*) AS n, round(avg((abs(actual - predicted) <= 1)::INTEGER), 8) AS within_one FROM g")
def l42w(t):
    return cl.within_one(cl.confusion(_graded(t), "actual", "predicted")).withColumn("within_one", r("within_one", 8))


@query("l43_class_recall", f"WITH g AS ({_GRADED}) SELECT actual, count(*) AS support, round(avg((actual = predicted)::INTEGER), 8) AS recall FROM g GROUP BY 1")
def l43(t):
    return cl.class_recall(cl.confusion(_graded(t), "actual", "predicted")).withColumn("recall", r("recall", 8))


@query("l47_class_weights", """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT toxic, n, round(sum(n) OVER () / (count(*) OVER () * n), 8) AS weight FROM c""")
def l47(t):
    return cl.class_weights(t.labels, "toxic").withColumn("weight", r("weight", 8))


@query("l48_oversampled_counts", """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT toxic, max(n) OVER () AS n, n AS n_distinct FROM c""")
def l48(t):
    return cl.oversample(t.labels, "toxic", "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_distinct"))


_SC = "SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, round(l_extendedprice / 105000, 6) AS p FROM lineitem"


def _scored(t):
    return t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), r(F.col("l_extendedprice") / 105000).alias("p"))


@query("l31_pr_curve", f"""WITH s AS ({_SC}), c AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1), k AS (SELECT p, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS tot FROM c WINDOW w AS (ORDER BY p DESC))
SELECT p AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / (tp + fp), 8) AS "precision", round(tp / tot, 8) AS recall FROM k""")
def l31(t):
    return cl.pr_curve(_scored(t), "y", "p").select("score", "tp", "fp", r("precision", 8).alias("precision"), r("recall", 8).alias("recall"))


@query("l31_average_precision", f"""WITH s AS ({_SC}), c AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1), k AS (SELECT pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS tot FROM c WINDOW w AS (ORDER BY p DESC))
SELECT round(sum(pos * tp / (tp + fp)) / any_value(tot), 8) AS average_precision FROM k""")
def l31a(t):
    return cl.average_precision(cl.pr_curve(_scored(t), "y", "p")).withColumn("average_precision", r("average_precision", 8))


@query("l31_threshold_table", f"""WITH s AS ({_SC}) SELECT CAST(th AS DOUBLE) AS threshold, count(*) FILTER (p >= th) AS flagged, round(count(*) FILTER (p >= th AND y = 1) / nullif(count(*) FILTER (p >= th), 0), 8) AS hit_rate,
round(count(*) FILTER (p >= th AND y = 1) / count(*) FILTER (y = 1), 8) AS recall FROM s CROSS JOIN (VALUES (0.25), (0.5), (0.75), (0.9)) AS v(th) GROUP BY 1, th""")
def l31t(t):
    out = cl.threshold_table(_scored(t), "y", "p", [0.25, 0.5, 0.75, 0.9])
    return out.select("threshold", "flagged", r("hit_rate", 8).alias("hit_rate"), r("recall", 8).alias("recall"))


@query("l50_reliability", f"""WITH s AS ({_SC}) SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS band, count(*) AS n, round(avg(p), 8) AS mean_score, round(avg(y), 8) AS observed FROM s GROUP BY 1""")
def l50(t):
    return cl.reliability(_scored(t), "y", "p").select("band", "n", r("mean_score", 8).alias("mean_score"), r("observed", 8).alias("observed"))


@query("l50_calibration_and_brier", f"""WITH s AS ({_SC}), b AS (SELECT least(floor(p * 10), 9) AS band, count(*) AS n, avg(p) AS m, avg(y) AS o FROM s GROUP BY 1)
SELECT round((SELECT sum(n * abs(m - o)) / sum(n) FROM b), 8) AS ece, round(avg(pow(p - y, 2)), 8) AS brier FROM s""")
def l50e(t):
    rows = _scored(t)
    both = attach(cl.calibration_error(cl.reliability(rows, "y", "p")), cl.brier(rows, "y", "p"))
    return both.select(r("ece", 8).alias("ece"), r("brier", 8).alias("brier"))


@query("l52_roc_auc", f"""WITH s AS ({_SC}), k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s),
c AS (SELECT sum(r) FILTER (y = 1) AS sr, count(*) FILTER (y = 1)::DOUBLE AS a, count(*) FILTER (y = 0)::DOUBLE AS b FROM k)
SELECT round((sr - a * (a + 1) / 2) / (a * b), 8) AS auc FROM c""")
def l52(t):
    return cl.roc_auc(_scored(t), "y", "p").select(r("auc", 8).alias("auc"))


@query("l57_decision_threshold", f"""WITH s AS ({_SC}) SELECT count(*) FILTER (p >= 0.7) AS flagged, round(avg(y) FILTER (p >= 0.7), 8) AS hit_rate FROM s""")
def l57(t):
    return cl.threshold_table(_scored(t), "y", "p", [0.7]).select("flagged", r("hit_rate", 8).alias("hit_rate"))


_FEATS = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
_IMP = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS a, abs(corr({c}, l_extendedprice * (1 - l_discount))) AS b FROM lineitem" for c in _FEATS)


@query("l58_rank_importances", f"""WITH i AS ({_IMP}) SELECT feature, CAST(row_number() OVER (ORDER BY a DESC, feature) AS BIGINT) AS rank_a, CAST(row_number() OVER (ORDER BY b DESC, feature) AS BIGINT) AS rank_b FROM i""")
def l58(t):
    rows = t.lineitem.withColumn("charge", F.col("l_extendedprice") * (1 - F.col("l_discount")))

    def ranked(target, name):
        one = rows.agg(*[F.abs(F.corr(c, target)).alias(c) for c in _FEATS]).unpivot([], list(_FEATS), "feature", "v")
        return sorted_scan(one, [], [F.desc("v"), F.col("feature")], row_number=name, bounded=True).select("feature", name)

    return ranked("l_extendedprice", "rank_a").join(ranked("charge", "rank_b"), "feature")


@query("l59_residual_check", f"""WITH {SQL_FILLED}, e AS (SELECT series, pos, x - lag(x, 24) OVER (PARTITION BY series ORDER BY pos) AS e FROM filled), d AS (SELECT series, pos, e - avg(e) OVER (PARTITION BY series) AS e, count(e) OVER (PARTITION BY series) AS n FROM e WHERE e IS NOT NULL),
ac AS (SELECT a.series, k, any_value(a.n) AS n, sum(a.e * b.e) AS g FROM d a CROSS JOIN generate_series(0, 12) AS t(k) JOIN d b ON b.series = a.series AND b.pos = a.pos - k GROUP BY 1, 2)
SELECT a.series, round(any_value(a.n) * (any_value(a.n) + 2) * sum(pow(a.g / z.g, 2) / (a.n - a.k)), 6) AS q FROM ac a JOIN ac z ON z.series = a.series AND z.k = 0 WHERE a.k > 0 GROUP BY 1""")
def l59(t):
    from tidewright.operators.diagnostics import ljung_box
    rows = look_around(hourly_filled(t), S, "pos", {"p": lag_of("x", 24)}).withColumn("e", F.col("x") - F.col("p")).filter("e IS NOT NULL")
    return ljung_box(settle(rows.select("series", "pos", "e")), S, "pos", "e", 12).filter("lag = 12").select("series", r("q").alias("q"))
