"""Queries: components, regimes, causality, anomalies, change points, volatility and risk."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tidewright.functions import columns as C
from tidewright.functions.gridtime import floor_to, position, slot_start
from tidewright.operators import anomaly, breaks, multivariate as mv, profile, risk
from tidewright.operators.ordering import attach
from tidewright.operators.risk import widen
from tidewright.plans.panels import S, SQL_EWMA_PAIRS, SQL_FILLED, SQL_MONTHLY, SQL_RETURNS, daily_filled, daily_returns, hourly_filled, monthly, r
from tidewright.plans.registry import query
from tidewright.session import settle

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
NAMES = {p: f"r{i}" for i, p in enumerate(PRIORITIES, 1)}


def _wide_returns(t):
    wide, _ = widen(daily_returns(t), "series", "pos", "ret")
    return settle(wide.withColumnsRenamed(NAMES).na.drop())


_WIDE = SQL_RETURNS + ", wide AS (SELECT * FROM (SELECT pos, " + ", ".join(
    f"max(ret) FILTER (series = '{p}') AS {n}" for p, n in NAMES.items()) + " FROM rets GROUP BY 1) WHERE " + " AND ".join(
    f"{n} IS NOT NULL" for n in NAMES.values()) + ")"


@query("m1_principal_components")
def m1(t):
    return mv.principal_components(_wide_returns(t), list(NAMES.values()))


@query("m1_two_column_components", """WITH c AS (SELECT corr(l_quantity, l_tax) AS r FROM lineitem)
SELECT 1 AS component, 'l_quantity' AS feature, round(1 / sqrt(2), 6) AS loading, round((1 + abs(r)) / 2, 7) AS explained FROM c
UNION ALL SELECT 1, 'l_tax', round(sign(r) / sqrt(2), 6), round((1 + abs(r)) / 2, 7) FROM c
UNION ALL SELECT 2, 'l_quantity', round(1 / sqrt(2), 6), round((1 - abs(r)) / 2, 7) FROM c UNION ALL SELECT 2, 'l_tax', round(-sign(r) / sqrt(2), 6), round((1 - abs(r)) / 2, 7) FROM c""")
def m1b(t):
    load = mv.principal_components(t.lineitem, ["l_quantity", "l_tax"])
    return load.select("component", "feature", r("loading").alias("loading"), r("explained", 7).alias("explained"))


@query("m1_component_scores")
def m1s(t):
    wide = _wide_returns(t)
    cols = list(NAMES.values())
    return mv.component_scores(wide, cols, mv.principal_components(wide, cols), 2).select("pos", "pc1", "pc2")


@query("m2_kmeans_regimes")
def m2(t):
    from tidewright.operators.clean import standardise
    cols = ["l_quantity", "l_discount", "l_extendedprice"]
    rows = standardise(t.lineitem.select("l_orderkey", "l_linenumber", *cols), cols)
    rows = rows.select("l_orderkey", "l_linenumber", *cols, F.array(*[c + "_z" for c in cols]).alias("f"))
    model = mv.kmeans(rows, "f", 4)
    return mv.assign(rows, model, "f").groupBy("cluster").agg(
        F.count("*").alias("n"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))


def _day_shapes(t):
    rows = hourly_filled(t).withColumn("day", floor_to(F.col("ts"), "day"))
    days = rows.groupBy("series", "day").agg(F.count("x").alias("k"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"),
                                             F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).filter("k = 24 AND s > 0")
    return settle(days.withColumn("shape", F.transform("v.x", lambda x: (x - F.col("m")) / F.col("s"))).select("series", "day", "shape"))


@query("m3_day_shape_clusters")
def m3(t):
    days = _day_shapes(t)
    return mv.assign(days, mv.kmeans(days, "shape", 4), "shape").select("series", "day", "cluster")


@query("m3_silhouette_by_k")
def m3k(t):
    return mv.silhouette_by_k(_day_shapes(t), "shape", [2, 3, 4])


@query("m4_regime_composition", """SELECT label, count(*) AS n, round(100 * avg((vec_id % 7 >= 5)::INTEGER), 6) AS weekend_pct,
round(100 * avg((vec_id % 12 IN (6, 7, 8))::INTEGER), 6) AS summer_pct FROM embeddings GROUP BY 1""")
def m4(t):
    v = F.col("vec_id")
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), r(100 * F.avg((v % 7 >= 5).cast("int"))).alias("weekend_pct"),
                                             r(100 * F.avg((v % 12).isin(6, 7, 8).cast("int"))).alias("summer_pct"))


@query("m4_cluster_by_month", """SELECT CAST(vec_id % 12 + 1 AS BIGINT) AS month, label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY vec_id % 12 + 1), 6) AS row_pct
FROM embeddings GROUP BY vec_id % 12 + 1, label""")
def m4m(t):
    rows = t.embeddings.withColumn("month", (F.col("vec_id") % 12 + 1))
    return profile.crosstab(rows, "month", "label").withColumn("row_pct", r("row_pct"))




def _composition(rows, regime, ts):
    out = profile.calendar_composition(rows, regime, ts)
    return out.select(regime, "part", "item", "n", *[r(c).alias(c) for c in ("pct", "all_pct", "lift")])


@query("m4_day_shapes_by_calendar")
def m4d(t):
    """The day-shape clusters by real weekday and month."""
    days = _day_shapes(t)
    return _composition(mv.assign(days, mv.kmeans(days, "shape", 4), "shape"), "cluster", "day")


@query("m4_price_regimes_by_calendar", """WITH o AS (SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'high' END AS regime, o_orderdate AS d FROM orders WHERE o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL),
c AS (SELECT regime, 'weekday' AS part, isodow(d) AS item, count(*) AS n FROM o GROUP BY 1, 3 UNION ALL SELECT regime, 'month', month(d), count(*) FROM o GROUP BY 1, 3),
p AS (SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY regime, part) AS pct, 100.0 * sum(n) OVER (PARTITION BY part, item) / sum(n) OVER (PARTITION BY part) AS all_pct FROM c)
SELECT regime, part, CAST(item AS INTEGER) AS item, n, round(pct, 6) AS pct, round(all_pct, 6) AS all_pct, round(pct / all_pct, 6) AS lift FROM p""")
def m4p(t):
    price = F.col("o_totalprice")
    rows = t.orders.where(price.isNotNull()).withColumn("regime", F.when(price < 50000, "low").when(price < 200000, "middle").otherwise("high"))
    return _composition(rows, "regime", "o_orderdate")


def _granger_sql():
    parts = [f"""SELECT '{e}' AS effect, '{c}' AS cause, count(*) AS n, corr(y, y1) AS a, corr(y, x1) AS b, corr(y1, x1) AS g FROM
(SELECT {e} AS y, lag({e}) OVER (ORDER BY pos) AS y1, lag({c}) OVER (ORDER BY pos) AS x1 FROM wide) WHERE y1 IS NOT NULL"""
             for e in NAMES.values() for c in NAMES.values() if e != c]
    return f"""WITH {_WIDE}, k AS ({' UNION ALL '.join(parts)}), u AS (SELECT *, (a * a + b * b - 2 * a * b * g) / (1 - g * g) AS r2 FROM k)
SELECT effect, cause, round((r2 - a * a) / ((1 - r2) / (n - 3)), 6) + 0.0 AS f FROM u"""


@query("m5_granger_first_lag", _granger_sql())
def m5(t):
    g = mv.granger(_wide_returns(t), "pos", list(NAMES.values()), 1)
    return g.select("effect", "cause", r("f").alias("f"))


@query("m5_granger_matrix")
def m5m(t):
    return mv.granger_matrix(mv.granger(_wide_returns(t), "pos", list(NAMES.values()), 5))


@query("m6_var_order")
def m6(t):
    return mv.var_order(_wide_returns(t), "pos", list(NAMES.values()), 5)


@query("m6_var_causality")
def m6c(t):
    return mv.var_causality(_wide_returns(t), "pos", list(NAMES.values()), 2)


_PAIRS = list(combinations(NAMES.values(), 2))


def _wide_prices(t):
    wide, _ = widen(daily_filled(t), "series", "pos", "x")
    return settle(wide.withColumnsRenamed(NAMES).na.drop())


_WIDEP = SQL_RETURNS + ", wide AS (SELECT * FROM (SELECT pos, " + ", ".join(
    f"max(x) FILTER (series = '{p}') AS {n}" for p, n in NAMES.items()) + " FROM dfilled GROUP BY 1) WHERE " + " AND ".join(
    f"{n} IS NOT NULL" for n in NAMES.values()) + ")"


@query("m7_hedge_ratio", f"WITH {_WIDEP} " + " UNION ALL ".join(
    f"SELECT '{a}|{b}' AS pair, round(regr_slope({a}, {b}), 8) + 0.0 AS beta, round(stddev_samp({a} - bb * {b}), 3) AS spread_sd FROM wide, (SELECT regr_slope({a}, {b}) AS bb FROM wide) GROUP BY bb" for a, b in _PAIRS))
def m7(t):
    rows = mv.pair_rows(_wide_prices(t), "pos", _PAIRS)
    both = attach(rows, mv.hedge_ratios(rows), ["pair"], max_rows=len(_PAIRS))
    return both.groupBy("pair", "beta").agg(r(F.stddev_samp(F.col("y") - F.col("beta") * F.col("x")), 3).alias("spread_sd")).withColumn("beta", r("beta", 8))


@query("m7_cointegration_scan")
def m7s(t):
    return mv.engle_granger(_wide_prices(t), "pos", list(combinations(NAMES.values(), 2)), 4)


_EG = SQL_RETURNS + ", wide AS (SELECT * FROM (SELECT pos, " + ", ".join(
    f"max(x) FILTER (series = '{p}') AS {n}" for p, n in NAMES.items()) + " FROM dfilled GROUP BY 1) WHERE " + " AND ".join(
    f"{n} IS NOT NULL" for n in NAMES.values()) + "), pw AS (" + " UNION ALL ".join(f"SELECT '{a}|{b}' AS pair, pos, {a} AS y, {b} AS x FROM wide" for a, b in _PAIRS) + """),
fb AS (SELECT pair, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM pw GROUP BY 1),
sp AS (SELECT pair, pos, y - b * x AS s, y - b * x - a AS e FROM pw JOIN fb USING (pair)),
df AS (SELECT pair, s - lag(s) OVER w AS ds, lag(s) OVER w AS s1, e - lag(e) OVER w AS de, lag(e) OVER w AS e1 FROM sp WINDOW w AS (PARTITION BY pair ORDER BY pos)),
ns AS (SELECT pair, count(*) AS n, sum(de * e1) / sum(e1 * e1) AS g, sum(e1 * e1) AS ee, sum(de * de) AS dd FROM df WHERE de IS NOT NULL GROUP BY 1),
cs AS (SELECT pair, count(*) AS n, regr_slope(ds, s1) AS g, regr_sxx(ds, s1) AS sxx, regr_syy(ds, s1) - pow(regr_sxy(ds, s1), 2) / regr_sxx(ds, s1) AS ssr FROM df WHERE ds IS NOT NULL GROUP BY 1)"""


@query("m7_cointegration_plain", f"""WITH {_EG} SELECT ns.pair, round(ns.g / sqrt((dd - ns.g * ns.g * ee) / (ns.n - 1) / ee), 5) + 0.0 AS coint_stat,
round(cs.g / sqrt(ssr / (cs.n - 2) / sxx), 5) + 0.0 AS spread_stat FROM ns JOIN cs USING (pair)""")
def m7p(t):
    out = mv.engle_granger(_wide_prices(t), "pos", _PAIRS, 0)
    return out.select("pair", r("coint_stat", 5).alias("coint_stat"), r("spread_stat", 5).alias("spread_stat"))


_ANOM = SQL_FILLED + """, res AS (SELECT series, ts, pos, x - avg(x) OVER (PARTITION BY series, isodow(ts) >= 6, hour(ts)) AS resid FROM filled),
zs AS (SELECT series, ts, pos, resid, resid / stddev_samp(resid) OVER (PARTITION BY series) AS z FROM res)"""


def _anomalies(t):
    rows = hourly_filled(t).withColumn("we", C.is_weekend(F.col("ts"))).withColumn("h", F.hour("ts"))
    return anomaly.residual_scores(rows, S, "x", ["we", "h"])


@query("m8_anomaly_scores", f"WITH {_ANOM} SELECT series, ts, round(resid, 9) + 0.0 AS resid, round(z, 6) + 0.0 AS z, abs(z) > 4 AS flagged FROM zs")
def m8(t):
    return _anomalies(t).select("series", "ts", r("resid", 9).alias("resid"), r("z").alias("z"), (F.abs("z") > 4).alias("flagged"))


@query("m9_extreme_anomalies", f"""WITH {_ANOM}, k AS (SELECT series, ts, round(z, 6) + 0.0 AS z FROM zs)
SELECT * FROM ((SELECT *, 'high' AS side FROM k ORDER BY z DESC, series, ts LIMIT 8) UNION ALL (SELECT *, 'low' FROM k ORDER BY z, series, ts LIMIT 8))""")
def m9(t):
    rows = settle(_anomalies(t).select("series", "ts", r("z").alias("z")))
    return anomaly.extremes(rows, "z", 8, ["series", "ts"])


@query("m9_anomaly_calendar", f"""WITH {_ANOM} SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) FILTER (abs(z) > 2) AS n_anomalies, round(avg(z), 6) + 0.0 AS mean_z FROM zs GROUP BY 1""")
def m9c(t):
    return _anomalies(t).groupBy(F.hour("ts").alias("hour")).agg(F.count_if(F.abs("z") > 2).alias("n_anomalies"), r(F.avg("z")).alias("mean_z"))


_SPLIT = SQL_RETURNS + """, c AS (SELECT series, pos, row_number() OVER w AS i, sum(x) OVER w AS l, sum(x) OVER (PARTITION BY series) AS tot, count(*) OVER (PARTITION BY series) AS n
FROM dfilled WINDOW w AS (PARTITION BY series ORDER BY pos)),
g AS (SELECT series, pos, l * l / i + (tot - l) * (tot - l) / (n - i) - tot * tot / n AS gain FROM c WHERE i >= 60 AND n - i >= 60)"""


@query("m10_best_split", f"""WITH {_SPLIT} SELECT series, CAST(max_by(pos, gain) + 1 AS BIGINT) AS break_pos FROM g GROUP BY 1""")
def m10(t):
    return anomaly.change_points(daily_filled(t), S, "pos", "x", 1, 60).select("series", "break_pos")


@query("m10_change_points")
def m10b(t):
    return anomaly.change_points(daily_filled(t), S, "pos", "x", 3, 60)


@query("m10_segment_means")
def m10s(t):
    rows = daily_filled(t)
    return anomaly.segment_means(rows, S, "pos", "x", anomaly.change_points(rows, S, "pos", "x", 2, 60, penalty=0.0))


@query("m10_segment_means_one_break", f"""WITH {_SPLIT}, b AS (SELECT series, max_by(pos, gain) + 1 AS bp FROM g GROUP BY 1)
SELECT series, CAST(pos >= bp AS INTEGER) AS segment, min(pos) AS first_pos, max(pos) AS last_pos, round(avg(x), 3) AS mean FROM dfilled JOIN b USING (series) GROUP BY 1, 2""")
def m10o(t):
    rows = daily_filled(t)
    out = anomaly.segment_means(rows, S, "pos", "x", anomaly.change_points(rows, S, "pos", "x", 1, 60))
    return out.select("series", "segment", "first_pos", "last_pos", r("mean", 3).alias("mean"))


@query("m10_exact_breaks", f"""WITH {SQL_RETURNS}, c AS (SELECT series, pos, row_number() OVER w AS i, sum(v) OVER w AS s, count(*) OVER (PARTITION BY series) AS n
FROM (SELECT *, x - avg(x) OVER (PARTITION BY series) AS v FROM dfilled) WINDOW w AS (PARTITION BY series ORDER BY pos)),
g AS (SELECT a.series, a.i AS i1, b.i AS i2, a.s * a.s / a.i + (b.s - a.s) * (b.s - a.s) / (b.i - a.i) + b.s * b.s / (b.n - b.i) AS gain
      FROM c a JOIN c b ON a.series = b.series AND a.i >= 60 AND b.i - a.i >= 60 AND b.n - b.i >= 60),
k AS (SELECT series, max_by({{'a': i1, 'b': i2}}, gain) AS k FROM g GROUP BY 1),
o AS (SELECT series, 1 AS number, k.a + 1 AS i FROM k UNION ALL SELECT series, 2, k.b + 1 FROM k)
SELECT o.series, o.number, c.pos AS break_pos FROM o JOIN c ON c.series = o.series AND c.i = o.i""")
def m10e(t):
    return breaks.fixed_breaks(daily_filled(t), S, "pos", "x", 2, 60).select("series", "number", "break_pos")


@query("m10_exact_segment_means")
def m10em(t):
    rows = daily_filled(t)
    return anomaly.segment_means(rows, S, "pos", "x", breaks.fixed_breaks(rows, S, "pos", "x", 3, 60))


@query("m10_penalised_breaks", f"""WITH RECURSIVE {SQL_MONTHLY},
c AS (SELECT series, pos, row_number() OVER (PARTITION BY series ORDER BY pos) AS i, x - avg(x) OVER (PARTITION BY series) AS v, 3 * var_pop(x) OVER (PARTITION BY series) AS beta FROM monthly),
t AS (SELECT *, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM c WINDOW w AS (PARTITION BY series ORDER BY i)),
l AS (SELECT series, any_value(beta) AS beta, count(*) AS n, list_concat([0.0::DOUBLE], list(s ORDER BY i)) AS s, list_concat([0.0::DOUBLE], list(q ORDER BY i)) AS q FROM t GROUP BY 1),
rec AS (SELECT series, CAST(0 AS BIGINT) AS i, [-beta] AS f, [CAST(-1 AS BIGINT)] AS way FROM l
        UNION ALL SELECT series, i + 1, list_append(f, list_min(o)), list_append(way, list_position(o, list_min(o)) - 1) FROM
          (SELECT rec.series, rec.i, f, way, list_transform(range(0, rec.i + 1), lambda b: CASE WHEN rec.i + 1 - b >= 2
             THEN f[b + 1] + q[rec.i + 2] - q[b + 1] - (s[rec.i + 2] - s[b + 1]) * (s[rec.i + 2] - s[b + 1]) / (rec.i + 1 - b) + beta ELSE 'infinity'::DOUBLE END) AS o
           FROM rec JOIN l ON l.series = rec.series WHERE rec.i < l.n)),
bt AS (SELECT rec.series, way, way[rec.i + 1] AS b FROM rec JOIN l ON l.series = rec.series AND rec.i = l.n
       UNION ALL SELECT series, way, way[b + 1] FROM bt WHERE b > 0)
SELECT bt.series, CAST(row_number() OVER (PARTITION BY bt.series ORDER BY b) AS INTEGER) AS number, c.pos AS break_pos FROM bt JOIN c ON c.series = bt.series AND c.i = bt.b + 1 WHERE b > 0""")
def m10p(t):
    return breaks.penalised_breaks(monthly(t), S, "pos", "x").select("series", "number", "break_pos")


@query("m11_deseasonalised", f"""WITH {SQL_RETURNS}, d AS (SELECT series, date_trunc('month', ts) AS ts, avg(x) AS m FROM dfilled GROUP BY 1, 2)
SELECT series, ts, round(m - avg(m) OVER (PARTITION BY series, month(ts)), 4) + 0.0 AS anomaly FROM d""")
def m11(t):
    m = daily_filled(t).groupBy("series", position(F.col("ts"), "month").alias("mp")).agg(F.avg("x").alias("m"))
    out = anomaly.deseasonalise(m, S, "m", F.pmod("mp", F.lit(12)), "a")
    return out.select("series", slot_start(F.col("mp"), "month").alias("ts"), r("a", 4).alias("anomaly"))


@query("m12_arch_lm_one_lag", f"""WITH {SQL_RETURNS}, q AS (SELECT series, pos, pow(ret - avg(ret) OVER (PARTITION BY series), 2) AS q FROM rets),
p AS (SELECT series, q, lag(q) OVER (PARTITION BY series ORDER BY pos) AS q1 FROM q)
SELECT series, count(*) AS n, round(count(*) * pow(corr(q, q1), 2), 5) + 0.0 AS lm_stat FROM p WHERE q1 IS NOT NULL GROUP BY 1""")
def m12(t):
    return risk.arch_lm(daily_returns(t), S, "pos", "ret", 1).select("series", "n", r("lm_stat", 5).alias("lm_stat"))


@query("m12_arch_lm_two_lags", f"""WITH {SQL_RETURNS}, q AS (SELECT series, pos, pow(ret - avg(ret) OVER (PARTITION BY series), 2) AS q FROM rets),
p AS (SELECT series, q, lag(q) OVER w AS q1, lag(q, 2) OVER w AS q2 FROM q WINDOW w AS (PARTITION BY series ORDER BY pos)),
c AS (SELECT series, count(*) AS n, corr(q, q1) AS a, corr(q, q2) AS b, corr(q1, q2) AS g FROM p WHERE q2 IS NOT NULL GROUP BY 1)
SELECT series, n, round(n * (a * a + b * b - 2 * a * b * g) / (1 - g * g), 5) + 0.0 AS lm_stat FROM c""")
def m12b(t):
    return risk.arch_lm(daily_returns(t), S, "pos", "ret", 2).select("series", "n", r("lm_stat", 5).alias("lm_stat"))


@query("m12_arch_lm")
def m12a(t):
    return risk.arch_lm(daily_returns(t), S, "pos", "ret", 12)


@query("m13_garch_panel")
def m13(t):
    return risk.garch_fit(daily_returns(t), S, "pos", "ret")


@query("m13_gjr_panel")
def m13g(t):
    return risk.garch_fit(daily_returns(t), S, "pos", "ret", asymmetric=True)


def _garch_sql(asymmetric: bool) -> str:
    """The fit as a recursion in SQL: every parameter set of the grid over every series, the largest likelihood kept."""
    sets = [p for p in risk.GARCH_GRID if asymmetric or p["gamma"] == 0]
    grid = ", ".join(f"({k}, {p['alpha']}::DOUBLE, {p['gamma']}::DOUBLE, {p['beta']}::DOUBLE)" for k, p in enumerate(sets))
    return f"""WITH RECURSIVE {SQL_RETURNS},
st AS (SELECT series, avg(ret) AS mu, var_samp(ret) AS v, count(*) AS n FROM rets GROUP BY 1),
sh AS MATERIALIZED (SELECT series, row_number() OVER (PARTITION BY series ORDER BY pos) AS i, (ret - mu) / sqrt(v) AS e FROM rets JOIN st USING (series)),
grid AS (SELECT * FROM (VALUES {grid}) AS g(k, a, g, b)),
rec AS (SELECT series, k, a, g, b, i, e, 1.0::DOUBLE AS s, 0.5 * (ln(2 * pi()) + e * e) AS loss FROM sh, grid WHERE i = 1
        UNION ALL SELECT series, k, a, g, b, i, e, s, loss + 0.5 * (ln(2 * pi()) + ln(s) + e * e / s) FROM
          (SELECT r.series, k, a, g, b, t.i, t.e, loss, b * s + (1 - a - g / 2 - b) + (a + CASE WHEN r.e < 0 THEN g ELSE 0 END) * r.e * r.e AS s
           FROM rec r JOIN sh t ON t.series = r.series AND t.i = r.i + 1)),
fin AS (SELECT rec.*, v, n, row_number() OVER (PARTITION BY rec.series ORDER BY loss, k) AS place FROM rec JOIN st ON st.series = rec.series AND rec.i = st.n)
SELECT series, a AS alpha, g AS gamma, b AS beta, round(a + g / 2 + b, 6) AS persistence, round(-loss - n * 0.5 * ln(v), 4) AS log_lik,
  round(v * (b * s + (1 - a - g / 2 - b) + (a + CASE WHEN e < 0 THEN g ELSE 0 END) * e * e), 4) AS next_variance FROM fin WHERE place = 1"""


def _garch_columns(fits):
    return fits.select("series", "alpha", "gamma", "beta", r("persistence").alias("persistence"), r("log_lik", 4).alias("log_lik"),
                       r("sigma2_next", 4).alias("next_variance"))


@query("m13_garch_likelihood", _garch_sql(False))
def m13l(t):
    return _garch_columns(risk.garch_fit(daily_returns(t), S, "pos", "ret"))


@query("m13_gjr_likelihood", _garch_sql(True))
def m13gl(t):
    return _garch_columns(risk.garch_fit(daily_returns(t), S, "pos", "ret", asymmetric=True))


@query("m13_news_impact")
def m13n(t):
    return risk.news_impact(risk.garch_fit(daily_returns(t), S, "pos", "ret", asymmetric=True), S, [-40, -20, -10, 0, 10, 20, 40])


@query("m13_term_structure")
def m13t(t):
    return risk.volatility_term_structure(risk.garch_fit(daily_returns(t), S, "pos", "ret"), S, 20, 252)


def _stated_fits(t):
    """Stated asymmetric parameters with each series' own long-run variance."""
    v = daily_returns(t).groupBy("series").agg(F.var_samp("ret").alias("v"), F.max_by("ret", "pos").alias("last"))
    return v.select("series", F.lit(0.08).alias("alpha"), F.lit(0.05).alias("gamma"), F.lit(0.85).alias("beta"), (F.col("v") * 0.045).alias("omega"),
                    F.lit(0.955).alias("persistence"), F.sqrt("v").alias("long_run_vol"), (F.col("last") ** 2).alias("sigma2_next"))


@query("m13_news_impact_stated", f"""WITH {SQL_RETURNS}, v AS (SELECT series, var_samp(ret) AS v FROM rets GROUP BY 1)
SELECT series, CAST(e AS DOUBLE) AS shock, round(v * 0.045 + (0.08 + CASE WHEN e < 0 THEN 0.05 ELSE 0 END) * e * e + 0.85 * v, 4) AS variance FROM v CROSS JOIN (VALUES (-30.0), (-10.0), (0.0), (10.0), (30.0)) AS s(e)""")
def m13ns(t):
    out = risk.news_impact(_stated_fits(t), S, [-30, -10, 0, 10, 30])
    return out.select("series", "shock", r("variance", 4).alias("variance"))


@query("m13_term_structure_stated", f"""WITH {SQL_RETURNS}, v AS (SELECT series, var_samp(ret) AS v, max_by(ret, pos) AS l FROM rets GROUP BY 1)
SELECT series, CAST(k AS INTEGER) AS step, round(sqrt((v + pow(0.955, k - 1) * (l * l - v)) * 252), 4) AS annual_vol FROM v CROSS JOIN generate_series(1, 20) AS g(k)""")
def m13ts(t):
    out = risk.volatility_term_structure(_stated_fits(t), S, 20, 252)
    return out.select("series", "step", r("annual_vol", 4).alias("annual_vol"))


_EWMA = SQL_RETURNS + """, st AS (SELECT series, avg(ret) AS mu, var_samp(ret) AS v0 FROM rets GROUP BY 1),
ix AS (SELECT series, pos, ts, ret, mu, v0, row_number() OVER (PARTITION BY series ORDER BY pos) - 1 AS i FROM rets JOIN st USING (series)),
sg AS (SELECT series, ts, pos, ret, mu, sqrt(pow(0.94, i) * (v0 + 0.06 * coalesce(sum(pow(ret - mu, 2) * pow(0.94, -(i + 1))) OVER (PARTITION BY series ORDER BY pos
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS sigma FROM ix),
qz AS (SELECT series, quantile_cont((ret - mu) / sigma, 0.05) AS q FROM sg GROUP BY 1),
vr AS (SELECT series, ts, pos, ret, sigma, -(mu + sigma * q) AS var5 FROM sg JOIN qz USING (series))"""


def _var_table(t):
    vol = settle(risk.ewma_volatility(daily_returns(t), S, "pos", "ret"))
    return risk.value_at_risk(vol, S, "ret", "sigma", "mu", 0.05)


@query("m14_value_at_risk", f"WITH {_EWMA} SELECT series, ts, round(sigma, 5) AS sigma, round(var5, 4) AS var5 FROM vr")
def m14(t):
    return _var_table(t).select("series", "ts", r("sigma", 5).alias("sigma"), r("var", 4).alias("var5"))


@query("m15_var_backtest", f"""WITH {_EWMA}, c AS (SELECT series, count(*) AS n, count(*) FILTER (ret < -var5) AS breaches FROM vr GROUP BY 1)
SELECT series, n, breaches, round(-2 * ((n - breaches) * ln(0.95) + breaches * ln(0.05) - ((n - breaches) * ln(1 - breaches / n) + breaches * ln(breaches / n))), 6) + 0.0 AS kupiec_lr FROM c""")
def m15(t):
    return risk.kupiec(_var_table(t), S, "ret", "var", 0.05).select("series", "n", "breaches", r("kupiec_lr").alias("kupiec_lr"))


@query("m15_var_backtest_p")
def m15p(t):
    return risk.kupiec(_var_table(t), S, "ret", "var", 0.05)


@query("m16_volatility_vs_reference", f"""WITH {_EWMA}, d AS (SELECT pos, avg(sigma) * sqrt(252) AS v, stddev_samp(ret) AS w FROM vr GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS n, round(corr(v, w), 6) + 0.0 AS corr, round(avg(v), 4) AS mean_v, round(avg(w), 4) AS mean_w FROM d""")
def m16(t):
    """Annualised model volatility, averaged over series, beside the spread of returns across series on the same day."""
    vol = settle(risk.ewma_volatility(daily_returns(t), S, "pos", "ret"))
    model = vol.groupBy("pos").agg((F.avg("sigma") * 252 ** 0.5).alias("v"))
    implied = vol.groupBy("pos").agg(F.stddev_samp("ret").alias("w"), F.count("*").alias("k")).filter("k > 1")
    return model.join(implied, "pos").agg(F.count("*").alias("n"), r(F.corr("v", "w")).alias("corr"), r(F.avg("v"), 4).alias("mean_v"), r(F.avg("w"), 4).alias("mean_w"))


@query("m17_diversification", f"WITH {SQL_EWMA_PAIRS} SELECT ts, round(sqrt(0.2 + 0.8 * greatest(rho, 0)), 6) AS ratio FROM rho")
def m17(t):
    out = risk.ewma_correlation(daily_returns(t), "series", "pos", "ret")
    return out.select(slot_start(F.col("pos"), "day").alias("ts"), r(risk.diversification_ratio("rho", 5)).alias("ratio"))
