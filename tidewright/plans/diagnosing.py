"""Queries: autocorrelation, stationarity, decomposition, spectra and long memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.gridtime import position, slot_start
from tidewright.operators import decompose, diagnostics as dg, spectrum, stl
from tidewright.operators.ordering import lag_of, look_around
from tidewright.plans.panels import S, SQL_FILLED, SQL_MONTHLY, SQL_RETURNS, daily_returns, hourly_filled, monthly, r
from tidewright.plans.registry import query

_DEV = SQL_FILLED + """,
dev AS (SELECT series, pos, x, x - avg(x) OVER (PARTITION BY series) AS e, count(*) OVER (PARTITION BY series) AS n FROM filled),
ac AS (SELECT a.series, CAST(k AS INTEGER) AS lag, any_value(a.n) AS n, sum(a.e * b.e) AS g FROM dev a CROSS JOIN generate_series(0, 26) AS t(k)
       JOIN dev b ON b.series = a.series AND b.pos = a.pos - k GROUP BY 1, 2),
acf AS (SELECT a.series, a.lag, a.n, a.g / z.g AS rho FROM ac a JOIN ac z ON z.series = a.series AND z.lag = 0 WHERE a.lag > 0)"""


@query("d1_acf", f"WITH {_DEV} SELECT series, lag, round(rho, 7) + 0.0 AS acf FROM acf")
def d1(t):
    return dg.acf(hourly_filled(t), S, "pos", "x", range(1, 27)).select("series", "lag", r("acf", 7).alias("acf"))


@query("d1_lag_correlation", f"""WITH {SQL_FILLED} SELECT a.series, CAST(k AS INTEGER) AS lag, round(corr(a.x, b.x), 7) + 0.0 AS corr FROM filled a
CROSS JOIN (VALUES (1), (24), (168)) AS t(k) JOIN filled b ON b.series = a.series AND b.pos = a.pos - k GROUP BY 1, 2""")
def d1c(t):
    return dg.lag_correlation(hourly_filled(t), S, "pos", "x", [1, 24, 168]).select("series", "lag", r("corr", 7).alias("corr"))


@query("d2_pacf", f"""WITH {_DEV}, w AS (SELECT series, max(rho) FILTER (lag = 1) AS r1, max(rho) FILTER (lag = 2) AS r2 FROM acf GROUP BY 1)
SELECT series, 1 AS lag, round(r1, 7) + 0.0 AS pacf FROM w UNION ALL SELECT series, 2, round((r2 - r1 * r1) / (1 - r1 * r1), 7) + 0.0 FROM w""")
def d2(t):
    return dg.pacf(hourly_filled(t), S, "pos", "x", 2).select("series", "lag", r("pacf", 7).alias("pacf"))


@query("d2_pacf_long")
def d2l(t):
    return dg.pacf(hourly_filled(t), S, "pos", "x", 48)


@query("d3_ljung_box", f"""WITH {_DEV} SELECT series, lag, round(n * (n + 2) * sum(rho * rho / (n - lag)) OVER (PARTITION BY series ORDER BY lag), 6) + 0.0 AS q FROM acf WHERE lag <= 24""")
def d3(t):
    return dg.ljung_box(hourly_filled(t), S, "pos", "x", 24).select("series", "lag", r("q").alias("q"))


_SQUARES = SQL_RETURNS + """,
dv AS (SELECT series, pos, ret * ret - avg(ret * ret) OVER (PARTITION BY series) AS e, count(*) OVER (PARTITION BY series) AS n FROM rets),
ac AS (SELECT a.series, k, any_value(a.n) AS n, sum(a.e * b.e) AS g FROM dv a CROSS JOIN generate_series(0, 12) AS t(k) JOIN dv b ON b.series = a.series AND b.pos = a.pos - k GROUP BY 1, 2)"""


@query("d3_ljung_box_squares", f"""WITH {_SQUARES} SELECT a.series, CAST(a.k AS INTEGER) AS lag, round(a.n * (a.n + 2) * sum(pow(a.g / z.g, 2) / (a.n - a.k)) OVER (PARTITION BY a.series ORDER BY a.k), 5) + 0.0 AS q
FROM ac a JOIN ac z ON z.series = a.series AND z.k = 0 WHERE a.k > 0""")
def d3s(t):
    rows = daily_returns(t).withColumn("sq", F.col("ret") * F.col("ret"))
    return dg.ljung_box(rows, S, "pos", "sq", 12).select("series", "lag", r("q", 5).alias("q"))


@query("d3_ljung_box_p_values")
def d3p(t):
    return dg.ljung_box(hourly_filled(t), S, "pos", "x", 24)


@query("d4_cross_correlation", """WITH a AS (SELECT o_orderdate AS ts, round(sum(o_totalprice), 2) AS u FROM orders GROUP BY 1), b AS (SELECT l_shipdate AS ts, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1),
w AS (SELECT ts, u, v FROM a JOIN b USING (ts)) SELECT CAST(k AS INTEGER) AS lag, round(corr(a.u, b.v), 7) + 0.0 AS corr FROM w a CROSS JOIN generate_series(-6, 6) AS t(k)
JOIN w b ON b.ts = a.ts + CAST(k AS INTEGER) * INTERVAL 1 DAY GROUP BY 1""")
def d4(t):
    a = t.orders.groupBy(position(F.col("o_orderdate"), "day").alias("pos")).agg(r(F.sum("o_totalprice"), 2).alias("u"))
    b = t.lineitem.groupBy(position(F.col("l_shipdate"), "day").alias("pos")).agg(r(F.sum("l_extendedprice"), 2).alias("v"))
    return dg.cross_correlation(a.join(b, "pos"), "pos", "u", "v", list(range(-6, 7))).withColumn("corr", r("corr", 7))


@query("d5_dickey_fuller_plain", f"""WITH {SQL_FILLED}, d AS (SELECT series, x - lag(x) OVER w AS dy, lag(x) OVER w AS y1 FROM filled WINDOW w AS (PARTITION BY series ORDER BY pos)),
f AS (SELECT series, count(*) AS n, regr_slope(dy, y1) AS b, regr_sxx(dy, y1) AS sxx, regr_syy(dy, y1) - pow(regr_sxy(dy, y1), 2) / regr_sxx(dy, y1) AS ssr FROM d WHERE dy IS NOT NULL GROUP BY 1)
SELECT series, round(b / sqrt(ssr / (n - 2) / sxx), 6) + 0.0 AS stat FROM f""")
def d5(t):
    return dg.adf(hourly_filled(t), S, "pos", "x", 0).select("series", r("stat").alias("stat"))


@query("d5_augmented_dickey_fuller")
def d5a(t):
    return dg.adf(hourly_filled(t), S, "pos", "x", 12)


_KPSS = SQL_FILLED + """,
dev AS (SELECT series, pos, x - avg(x) OVER (PARTITION BY series) AS e, count(*) OVER (PARTITION BY series) AS n FROM filled),
eta AS (SELECT series, any_value(n) AS n, sum(s * s) / pow(any_value(n), 2) AS eta FROM (SELECT series, n, sum(e) OVER (PARTITION BY series ORDER BY pos) AS s FROM dev) GROUP BY 1),
ac AS (SELECT a.series, k, sum(a.e * b.e) AS g FROM dev a CROSS JOIN generate_series(0, 12) AS t(k) JOIN dev b ON b.series = a.series AND b.pos = a.pos - k GROUP BY 1, 2),
lr AS (SELECT series, sum(CASE WHEN k = 0 THEN g ELSE 2 * g * (1 - k / 13.0) END) AS v FROM ac GROUP BY 1)"""


@query("d6_kpss", f"WITH {_KPSS} SELECT series, round(eta / (v / n), 7) AS stat FROM eta JOIN lr USING (series)")
def d6(t):
    return dg.kpss(hourly_filled(t), S, "pos", "x", n_lags=12).select("series", r("stat", 7).alias("stat"))


_KPSS_TREND = _KPSS.replace("x - avg(x) OVER (PARTITION BY series) AS e",
    "x - regr_intercept(x, pos) OVER (PARTITION BY series) - regr_slope(x, pos) OVER (PARTITION BY series) * pos AS e")


@query("d6_kpss_trend", f"WITH {_KPSS_TREND} SELECT series, round(eta / (v / n), 5) AS stat FROM eta JOIN lr USING (series)")
def d6t(t):
    return dg.kpss(hourly_filled(t), S, "pos", "x", regression="ct", n_lags=12).select("series", r("stat", 5).alias("stat"))


_KPSS_AUTO = SQL_FILLED + """,
dev AS (SELECT series, pos, x - avg(x) OVER (PARTITION BY series) AS e, count(*) OVER (PARTITION BY series) AS n FROM filled),
eta AS (SELECT series, any_value(n) AS n, sum(s * s) / pow(any_value(n), 2) AS eta FROM (SELECT series, n, sum(e) OVER (PARTITION BY series ORDER BY pos) AS s FROM dev) GROUP BY 1),
ac AS (SELECT a.series, k, any_value(a.n) AS n, sum(a.e * b.e) AS g FROM dev a CROSS JOIN generate_series(0, 60) AS t(k) JOIN dev b ON b.series = a.series AND b.pos = a.pos - k GROUP BY 1, 2),
sh AS (SELECT series, any_value(n) AS n, sum(CASE WHEN k = 0 THEN g / n ELSE 2 * g / n END) AS s0, sum(k * 2 * g / n) AS s1 FROM ac WHERE k <= floor(pow(n, 2.0 / 9)) GROUP BY 1),
wd AS (SELECT series, CAST(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)) AS INTEGER) AS w FROM sh),
lr AS (SELECT series, any_value(w) AS w, sum(CASE WHEN k = 0 THEN g ELSE 2 * g * (1 - k / (w + 1.0)) END) / any_value(n) AS v FROM ac JOIN wd USING (series) WHERE k <= w GROUP BY 1)"""


@query("d6_kpss_automatic", f"""WITH {_KPSS_AUTO} SELECT series, w AS n_lags, round(eta / v, 7) AS stat FROM eta JOIN lr USING (series)""")
def d6a(t):
    return dg.kpss(hourly_filled(t), S, "pos", "x").select("series", "n_lags", r("stat", 7).alias("stat"))


@query("d7_stationarity_verdict")
def d7(t):
    return dg.stationarity_report(hourly_filled(t), S, "pos", "x", 8, n_lags=12)


# ------------------------------------------------------------------ decomposition
_CLASSICAL = SQL_FILLED + """,
tr AS (SELECT series, pos, ts, x, CASE WHEN count(x) OVER a = 24 AND count(x) OVER b = 24 THEN (avg(x) OVER a + avg(x) OVER b) / 2 END AS trend FROM filled
       WINDOW a AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING), b AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING)),
ph AS (SELECT series, pos % 24 AS ph, {agg} AS s FROM tr GROUP BY 1, 2),
se AS (SELECT series, ph, s - avg(s) OVER (PARTITION BY series) AS seasonal FROM ph),
parts AS (SELECT tr.series, tr.ts, tr.pos, tr.x, trend, seasonal, x - trend - seasonal AS resid FROM tr JOIN se ON se.series = tr.series AND se.ph = tr.pos % 24)"""


@query("d8_classical_decomposition", f"""WITH {_CLASSICAL.format(agg='avg(x - trend)')} SELECT series, ts, round(trend, 8) AS trend, round(seasonal, 8) + 0.0 AS seasonal, round(resid, 8) + 0.0 AS resid FROM parts""")
def d8(t):
    p = decompose.classical(hourly_filled(t), S, "pos", "x", 24)
    return p.select("series", "ts", r("trend", 8).alias("trend"), r("seasonal", 8).alias("seasonal"), r("resid", 8).alias("resid"))


_MULTI = _CLASSICAL.format(agg="avg(x - trend)") + """,
l1 AS (SELECT series, ts, pos, x, seasonal AS s24, x - seasonal AS lft FROM parts),
tr2 AS (SELECT *, CASE WHEN count(lft) OVER a = 168 AND count(lft) OVER b = 168 THEN (avg(lft) OVER a + avg(lft) OVER b) / 2 END AS trend FROM l1
        WINDOW a AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING), b AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 83 PRECEDING AND 84 FOLLOWING)),
ph2 AS (SELECT series, pos % 168 AS ph, avg(lft - trend) AS s FROM tr2 GROUP BY 1, 2),
se2 AS (SELECT series, ph, s - avg(s) OVER (PARTITION BY series) AS s168 FROM ph2),
l2 AS (SELECT t.series, t.ts, t.pos, t.x, s24, s168, lft - s168 AS lft FROM tr2 t JOIN se2 ON se2.series = t.series AND se2.ph = t.pos % 168),
mp AS (SELECT *, CASE WHEN count(lft) OVER a = 168 AND count(lft) OVER b = 168 THEN (avg(lft) OVER a + avg(lft) OVER b) / 2 END AS trend FROM l2
        WINDOW a AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING), b AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 83 PRECEDING AND 84 FOLLOWING))"""


@query("d9_multi_seasonal", f"""WITH {_MULTI} SELECT series, ts, round(s24, 8) + 0.0 AS seasonal_24, round(s168, 8) + 0.0 AS seasonal_168, round(trend, 8) AS trend, round(lft - trend, 8) + 0.0 AS resid FROM mp""")
def d9(t):
    p = decompose.multi_seasonal(hourly_filled(t), S, "pos", "x", [24, 168])
    return p.select("series", "ts", *[r(c, 8).alias(c) for c in ("seasonal_24", "seasonal_168", "trend", "resid")])


@query("d10_robust_decomposition", f"""WITH {_CLASSICAL.format(agg='quantile_cont(x - trend, 0.5)')} SELECT series, ts, round(seasonal, 8) + 0.0 AS seasonal, round(resid, 8) + 0.0 AS resid FROM parts""")
def d10(t):
    p = decompose.classical(hourly_filled(t), S, "pos", "x", 24, robust=True)
    return p.select("series", "ts", r("seasonal", 8).alias("seasonal"), r("resid", 8).alias("resid"))


@query("d11_strengths", f"""WITH {_CLASSICAL.format(agg='avg(x - trend)')} SELECT series, round(greatest(0, 1 - var_samp(resid) / var_samp(trend + resid)), 6) + 0.0 AS trend_strength,
round(greatest(0, 1 - var_samp(resid) / var_samp(seasonal + resid)), 6) + 0.0 AS seasonal_strength, round(max(seasonal) - min(seasonal), 5) AS seasonal_swing, round(max(trend) - min(trend), 5) AS trend_swing
FROM parts WHERE resid IS NOT NULL GROUP BY 1""")
def d11(t):
    s = decompose.strengths(decompose.classical(hourly_filled(t), S, "pos", "x", 24), S, ["seasonal"])
    return s.select("series", r("trend_strength").alias("trend_strength"), r("seasonal_strength").alias("seasonal_strength"),
                    r("seasonal_swing", 5).alias("seasonal_swing"), r("trend_swing", 5).alias("trend_swing"))


# ------------------------------------------------------------------ local regression
def _sql_lines(out: str, points: str, values: str, keys: str, window: int) -> str:
    """Local lines through ``values(keys, i, v, w)`` at ``points(keys, x, m)``, m slots: the nearest slots, tricube weights, a regression."""
    same = " AND ".join(f"v.{k} = q.{k}" for k in keys.split(", "))
    own = ", ".join(f"q.{k}" for k in keys.split(", "))
    return f"""{out}_w AS (SELECT *, greatest(0, least(x - {window // 2}, m - {window})) AS lo, least({window}, m) AS width FROM {points}),
{out}_k AS (SELECT {own}, q.x, v.i - q.x AS d, v.v, v.w * pow(greatest(0, 1 - pow(abs(v.i - q.x) / (greatest(abs(lo - q.x), abs(lo + width - 1 - q.x)) + greatest({window} - m, 0) // 2)::DOUBLE, 3)), 3) AS k
  FROM {out}_w q JOIN {values} v ON {same} AND v.i >= q.lo AND v.i < q.lo + q.width),
{out}_s AS (SELECT {keys}, x, sum(k * v) / sum(k) AS l, sum(k * d) / sum(k) AS b, sum(k * d * d) / sum(k) - pow(sum(k * d) / sum(k), 2) AS s, sum(k * d * v) / sum(k) AS c FROM {out}_k GROUP BY {keys}, x),
{out} AS (SELECT {keys}, x, CASE WHEN s > 1e-6 THEN l - b * (c - b * l) / s ELSE l END AS f FROM {out}_s)"""


def _sql_pass(tag: str, source: str, period: int = 24, seasonal: int = 7, trend: int = 47) -> str:
    """One pass of the decomposition over ``source(series, i, n, y, t, w)``: ``<tag>(series, i, n, y, s, t)``."""
    p, low = period, period + 1 + period % 2
    return f"""{tag}_v AS (SELECT series, i % {p} AS ph, i // {p} AS i, y - t AS v, w FROM {source}),
{tag}_m AS (SELECT series, ph, count(*) AS m FROM {tag}_v GROUP BY 1, 2),
{tag}_p AS (SELECT series, ph, x, m FROM {tag}_m, unnest(generate_series(-1, m)) AS u(x)),
{_sql_lines(tag + "_c", tag + "_p", tag + "_v", "series, ph", seasonal)},
{tag}_a AS (SELECT series, (x + 1) * {p} + ph AS i, f AS c FROM {tag}_c),
{tag}_b AS (SELECT *, avg(c) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND {p - 1} FOLLOWING) AS a1 FROM {tag}_a),
{tag}_d AS (SELECT *, avg(a1) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND {p - 1} FOLLOWING) AS a2 FROM {tag}_b),
{tag}_e AS (SELECT *, avg(a2) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a3 FROM {tag}_d),
{tag}_f AS (SELECT e.series, e.i, e.a3 AS v, 1.0 AS w FROM {tag}_e e JOIN {source} o ON o.series = e.series AND o.i = e.i),
{tag}_g AS (SELECT series, i AS x, n AS m FROM {source}),
{_sql_lines(tag + "_l", tag + "_g", tag + "_f", "series", low)},
{tag}_h AS (SELECT o.series, o.i, o.n, o.y, o.w, c.c - l.f AS s, o.y - (c.c - l.f) AS v FROM {source} o JOIN {tag}_a c ON c.series = o.series AND c.i = o.i + {p} JOIN {tag}_l l ON l.series = o.series AND l.x = o.i),
{_sql_lines(tag + "_t", tag + "_g", tag + "_h", "series", trend)},
{tag} AS (SELECT h.series, h.i, h.n, h.y, h.s, t.f AS t FROM {tag}_h h JOIN {tag}_t t ON t.series = h.series AND t.x = h.i)"""


_STL = SQL_FILLED + f""",
base AS (SELECT series, ts, pos - min(pos) OVER w AS i, count(*) OVER w AS n, x AS y, 0.0 AS t, 1.0::DOUBLE AS w FROM filled WINDOW w AS (PARTITION BY series)),
{_sql_pass("one", "base")},
mid AS (SELECT series, 6 * quantile_cont(abs(y - s - t), 0.5) AS h FROM one GROUP BY 1),
again AS (SELECT series, i, n, y, t, pow(greatest(0, 1 - pow((y - s - t) / h, 2)), 2) AS w FROM one JOIN mid USING (series)),
{_sql_pass("two", "again")}"""


@query("d10_local_regression_round", f"""WITH {_STL} SELECT o.series, b.ts, round(o.t, 6) + 0.0 AS trend, round(o.s, 6) + 0.0 AS seasonal, round(o.y - o.s - o.t, 6) + 0.0 AS resid, round(a.w, 6) + 0.0 AS weight
FROM two o JOIN base b ON b.series = o.series AND b.i = o.i JOIN again a ON a.series = o.series AND a.i = o.i""")
def d10_round(t):
    """One pass, robustness weights, and one pass more."""
    p = stl.stl(hourly_filled(t), S, "pos", "x", 24, inner=1, outer=1).withColumn("ts", slot_start(F.col("pos"), "hour"))
    return p.select("series", "ts", *[r(c).alias(c) for c in ("trend", "seasonal", "resid")], r("robust").alias("weight"))


@query("d10_robust_local_regression")
def d10_stl(t):
    p = stl.stl(hourly_filled(t), S, "pos", "x", 24, robust=True).withColumn("ts", slot_start(F.col("pos"), "hour"))
    return p.select("series", "ts", *[r(c).alias(c) for c in ("trend", "seasonal", "resid")], r("robust").alias("weight"))


@query("d9_multi_local_regression")
def d9_stl(t):
    p = stl.multi_stl(hourly_filled(t), S, "pos", "x", [24, 168]).withColumn("ts", slot_start(F.col("pos"), "hour"))
    return p.select("series", "ts", *[r(c).alias(c) for c in ("seasonal_24", "seasonal_168", "trend", "resid")])


# ------------------------------------------------------------------ spectra
@query("d12_candidate_power", f"""WITH {SQL_FILLED}, dev AS (SELECT series, pos - min(pos) OVER (PARTITION BY series) AS t, x - avg(x) OVER (PARTITION BY series) AS e FROM filled)
SELECT series, CAST(p AS DOUBLE) AS period, round(2 * (pow(sum(e * cos(2 * pi() * t / p)), 2) + pow(sum(e * sin(2 * pi() * t / p)), 2)) / count(*), 2) AS power
FROM dev CROSS JOIN (VALUES (12.0), (24.0), (84.0), (168.0)) AS c(p) GROUP BY 1, 2""")
def d12(t):
    return dg.power_at(hourly_filled(t), S, "pos", "x", [12, 24, 84, 168]).select("series", "period", r("power", 2).alias("power"))


_SPEC = SQL_FILLED + """,
seg AS (SELECT series, (pos - p0) // 168 AS seg, (pos - p0) % 168 AS t, x FROM (SELECT *, min(pos) OVER (PARTITION BY series) AS p0 FROM filled)),
dv AS (SELECT series, seg, t, x - avg(x) OVER (PARTITION BY series, seg) AS e, count(*) OVER (PARTITION BY series, seg) AS m FROM seg),
sp AS (SELECT series, seg, k, (CASE WHEN k = 84 THEN 1 ELSE 2 END) * (pow(sum(e * cos(2 * pi() * k * t / 168)), 2) + pow(sum(e * sin(2 * pi() * k * t / 168)), 2)) / 168 AS power
       FROM dv CROSS JOIN generate_series(1, 84) AS g(k) WHERE m = 168 GROUP BY 1, 2, 3),
ms AS (SELECT series, CAST(k AS INTEGER) AS k, avg(power) AS power FROM sp GROUP BY 1, 2)"""


@query("d12_mean_spectrum", f"WITH {_SPEC} SELECT series, k, round(power, 3) AS power FROM ms")
def d12s(t):
    return dg.mean_spectrum(hourly_filled(t), S, "pos", "x", 168).select("series", "k", r("power", 3).alias("power"))


_WHOLE = SQL_FILLED + """,
dev AS (SELECT series, pos - min(pos) OVER w AS t, x - avg(x) OVER w AS e, count(*) OVER w AS n FROM filled WINDOW w AS (PARTITION BY series)),
whole AS (SELECT series, k, any_value(n) AS n, (CASE WHEN 2 * k = any_value(n) THEN 1 ELSE 2 END) * (pow(sum(e * cos(2 * pi() * (k * t % n) / n)), 2) + pow(sum(e * sin(2 * pi() * (k * t % n) / n)), 2)) / any_value(n) AS power
          FROM dev, unnest(generate_series(1, n // 2)) AS u(k) GROUP BY 1, 2)"""


@query("d12_whole_spectrum", f"WITH {_WHOLE} SELECT series, k, round(n / k, 6) AS period, round(power, 3) AS power FROM whole")
def d12w(t):
    return spectrum.whole_spectrum(hourly_filled(t), S, "pos", "x").select("series", "k", r("period").alias("period"), r("power", 3).alias("power"))


@query("d12_dominant_periods", f"""WITH {_WHOLE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY power DESC, k) AS rank, power / sum(power) OVER (PARTITION BY series) AS share FROM whole)
SELECT series, CAST(rank AS INTEGER) AS rank, k, round(n / k, 6) AS period, round(share, 6) AS share FROM ranked WHERE rank <= 5""")
def d12d(t):
    p = spectrum.dominant_periods(spectrum.whole_spectrum(hourly_filled(t), S, "pos", "x"), S, 5)
    return p.select("series", "rank", "k", r("period").alias("period"), r("share").alias("share"))


@query("d13_band_power", f"""WITH {SQL_FILLED}, base AS (SELECT series, pos - min(pos) OVER (PARTITION BY series) AS t, x FROM filled),
seg AS (SELECT series, s AS segment, t - s * 84 AS u, x FROM base CROSS JOIN generate_series(0, 20) AS g(s) WHERE t >= s * 84 AND t < s * 84 + 168),
dv AS (SELECT series, segment, u, x - avg(x) OVER w AS e, count(*) OVER w AS m, least(u, 167 - u) AS near FROM seg WINDOW w AS (PARTITION BY series, segment)),
tp AS (SELECT *, CASE WHEN near < 0.25 * 167 / 2 THEN 0.5 * (1 + cos(pi() * (near / (0.25 * 167 / 2) - 1))) ELSE 1.0 END AS w FROM dv WHERE m = 168)
SELECT series, segment, round(2 * (pow(sum(e * w * cos(2 * pi() * 7 * u / 168)), 2) + pow(sum(e * w * sin(2 * pi() * 7 * u / 168)), 2)) / sum(w * w), 3) AS power FROM tp GROUP BY 1, 2""")
def d13(t):
    return dg.band_power(hourly_filled(t), S, "pos", "x", 168, 84, (22, 26)).select("series", "segment", r("power", 3).alias("power"))


@query("d14_spectral_entropy", f"""WITH {_SPEC}, sh AS (SELECT series, power / sum(power) OVER (PARTITION BY series) AS p FROM ms)
SELECT series, round(-sum(p * ln(p)) / ln(count(*)), 7) AS entropy FROM sh GROUP BY 1""")
def d14(t):
    return dg.spectral_entropy(hourly_filled(t), S, "pos", "x", 168).withColumn("entropy", r("entropy", 7))


@query("d15_hurst", f"""WITH {SQL_FILLED}, b AS (SELECT series, pos - min(pos) OVER (PARTITION BY series) AS t, x, count(*) OVER (PARTITION BY series) AS n FROM filled),
s AS (SELECT series, CAST(z AS BIGINT) AS z, t // z AS seg, t, x FROM b CROSS JOIN (SELECT CAST(floor(10.0::DOUBLE * pow(1.5::DOUBLE, k)) AS BIGINT) AS z FROM range(60) AS g(k)) AS v
      WHERE z <= n / 4 AND t // z < n // z),
d AS (SELECT series, z, seg, t, x - avg(x) OVER w AS e, stddev_pop(x) OVER w AS sd FROM s WINDOW w AS (PARTITION BY series, z, seg)),
c AS (SELECT series, z, seg, sd, sum(e) OVER (PARTITION BY series, z, seg ORDER BY t) AS cum FROM d),
rs AS (SELECT series, z, avg(v) AS rs FROM (SELECT series, z, seg, (max(cum) - min(cum)) / any_value(sd) AS v FROM c WHERE sd > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT series, round(regr_slope(ln(rs), ln(z)), 7) AS hurst FROM rs GROUP BY 1""")
def d15(t):
    return dg.hurst(hourly_filled(t), S, "pos", "x").withColumn("hurst", r("hurst", 7))


@query("d16_month_seasonality", f"""WITH {SQL_MONTHLY}, g AS (SELECT series, ts, x / lag(x) OVER (PARTITION BY series ORDER BY ts) - 1 AS chg FROM monthly)
SELECT CAST(month(ts) AS INTEGER) AS month, count(chg) AS n, round(avg(chg) * 100, 6) + 0.0 AS mean_pct, round(stddev_samp(chg) * 100, 6) AS sd_pct FROM g GROUP BY 1""")
def d16(t):
    rows = look_around(monthly(t), S, "pos", {"_l": lag_of("x")}).withColumn("chg", F.col("x") / F.col("_l") - 1)
    return rows.groupBy(F.month("ts").alias("month")).agg(F.count("chg").alias("n"), r(F.avg("chg") * 100).alias("mean_pct"), r(F.stddev_samp("chg") * 100).alias("sd_pct"))


@query("d17_over_differencing", f"""WITH {SQL_FILLED}, d AS (SELECT series, pos, x, x - lag(x) OVER w AS d1 FROM filled WINDOW w AS (PARTITION BY series ORDER BY pos)),
e AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY series ORDER BY pos) AS d2 FROM d), f AS (SELECT *, lag(x) OVER w AS lx, lag(d1) OVER w AS l1, lag(d2) OVER w AS l2 FROM e WINDOW w AS (PARTITION BY series ORDER BY pos))
SELECT series, round(var_samp(x), 3) AS var_0, round(var_samp(d1), 3) AS var_1, round(var_samp(d2), 3) AS var_2, round(corr(x, lx), 6) + 0.0 AS r_0, round(corr(d1, l1), 6) + 0.0 AS r_1, round(corr(d2, l2), 6) + 0.0 AS r_2 FROM f GROUP BY 1""")
def d17(t):
    rows = look_around(hourly_filled(t), S, "pos", {f"_{k}": lag_of("x", k) for k in (1, 2, 3)})
    x, a, b, c = (F.col(n) for n in ("x", "_1", "_2", "_3"))
    rows = rows.select("series", "x", a.alias("lx"), (x - a).alias("d1"), (a - b).alias("l1"), (x - 2 * a + b).alias("d2"), (a - 2 * b + c).alias("l2"))
    return rows.groupBy("series").agg(*[r(F.var_samp(v), 3).alias(n) for v, n in (("x", "var_0"), ("d1", "var_1"), ("d2", "var_2"))],
                                      *[r(F.corr(v, w)).alias(n) for v, w, n in (("x", "lx", "r_0"), ("d1", "l1", "r_1"), ("d2", "l2", "r_2"))])
