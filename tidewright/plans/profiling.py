"""Queries: aggregates, profiles, distribution and association statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import columns as C
from tidewright.functions.gridtime import floor_to
from tidewright.operators import assoc, clean, grid, profile
from tidewright.operators.ordering import attach, quantiles
from tidewright.plans.cleaning import AQI_BANDS, AQI_EDGES, SQL_BAND
from tidewright.plans.panels import (S, SQL_FILLED, SQL_HOURLY, SQL_MONTHLY, SQL_RETURNS, daily_returns, hourly_filled,
                                     hourly_grid, monthly, r)
from tidewright.plans.registry import query


@query("a1_moments", """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(skewness(value), 6) AS skew,
round(kurtosis(value), 5) AS excess_kurtosis, min(value) AS min, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS max FROM events GROUP BY 1""")
def a1(t):
    m = profile.moments(t.events, "value", ["event_type"])
    return m.select("event_type", "n", r("mean").alias("mean"), r("std").alias("std"), r("skew").alias("skew"),
                    r("excess_kurtosis", 5).alias("excess_kurtosis"), "min", r("median").alias("median"), "max")


@query("a2_calendar_means", """SELECT CAST(month(o_orderdate) AS INTEGER) AS month, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dow, count(*) AS n,
round(avg(o_totalprice), 4) AS mean_price, max(o_totalprice) AS max_price FROM orders GROUP BY 1, 2""")
def a2(t):
    return t.orders.groupBy(F.month("o_orderdate").alias("month"), F.weekday("o_orderdate").alias("dow")).agg(
        F.count("*").alias("n"), r(F.avg("o_totalprice"), 4).alias("mean_price"), F.max("o_totalprice").alias("max_price"))


@query("a2_across_entities", f"""WITH {SQL_MONTHLY} SELECT ts, count(*) AS k, round(avg(x), 6) AS mean_x FROM monthly GROUP BY 1""")
def a2e(t):
    return monthly(t).groupBy("ts").agg(F.count("*").alias("k"), r(F.avg("x")).alias("mean_x"))


@query("a3_pivot", """SELECT CAST(month(l_shipdate) AS INTEGER) AS month, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS a,
round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS n, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS r FROM lineitem GROUP BY 1""")
def a3(t):
    out = t.lineitem.groupBy(F.month("l_shipdate").alias("month")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))
    return out.select("month", r("A").alias("a"), r("N").alias("n"), r("R").alias("r"))


@query("a4_crosstab", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS row_pct
FROM lineitem GROUP BY 1, 2""")
def a4(t):
    return profile.crosstab(t.lineitem, "l_returnflag", "l_linestatus").withColumn("row_pct", r("row_pct"))


@query("a5_frequencies", """SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM orders GROUP BY 1""")
def a5(t):
    return profile.frequencies(t.orders, ["o_orderpriority"]).withColumn("share", r("share", 8))


_PROF = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("a6_column_profile", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct,
round(count(*) FILTER ({c} = 0) * 100.0 / count({c}), 6) AS pct_zero, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM lineitem""" for c in _PROF))
def a6(t):
    return clean.profile(t.lineitem, _PROF, approximate=False).withColumn("pct_zero", r("pct_zero"))


@query("a7_exact_quantiles", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""")
def a7(t):
    q = quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p05": .05, "p50": .5, "p90": .9, "p99": .99})
    return q.select("l_returnflag", *[r(c).alias(c) for c in ("p05", "p50", "p90", "p99")])


@query("a8_mad", """WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1)
SELECT event_type, round(any_value(median), 6) AS median, round(quantile_cont(abs(value - median), 0.5), 6) AS mad FROM events JOIN m USING (event_type) GROUP BY 1""")
def a8(t):
    m = profile.mad(t.events.select("event_type", "value"), "value", ["event_type"])
    return m.select("event_type", r("median").alias("median"), r("mad").alias("mad"))


@query("a9_broadcast_group_mean", f"""WITH {SQL_FILLED} SELECT series, ts, round(x - avg(x) OVER (PARTITION BY series, isodow(ts), hour(ts)), 5) + 0.0 AS resid FROM filled""")
def a9(t):
    rows = hourly_filled(t).withColumn("d", F.weekday("ts")).withColumn("h", F.hour("ts"))
    means = rows.groupBy("series", "d", "h").agg(F.avg("x").alias("m"))
    return attach(rows, means, ["series", "d", "h"]).select("series", "ts", r(F.col("x") - F.col("m"), 5).alias("resid"))


@query("a10_arg_extremes", """WITH h AS (SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, CAST(arg_max(hour, n * 100 - hour) AS INTEGER) AS busiest, CAST(arg_min(hour, n * 100 + hour) AS INTEGER) AS quietest FROM h GROUP BY 1""")
def a10(t):
    h = t.events.groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return h.groupBy("event_type").agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("busiest"),
                                       F.min_by("hour", F.struct("n", "hour")).alias("quietest"))


@query("a11_mode", """SELECT l_returnflag, l_quantity AS most_common FROM (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag
ORDER BY count(*) DESC, l_quantity) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1""")
def a11(t):
    counts = t.lineitem.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    return counts.groupBy("l_returnflag").agg(F.max_by("l_quantity", F.struct("n", -F.col("l_quantity"))).alias("most_common"))


@query("a12_day_vectors", f"""WITH {SQL_FILLED} SELECT series, date_trunc('day', ts) AS day, list(x ORDER BY ts) AS shape FROM filled
GROUP BY 1, 2 HAVING count(x) = 24""")
def a12(t):
    days = hourly_filled(t).groupBy("series", floor_to(F.col("ts"), "day").alias("day")).agg(
        F.count("x").alias("k"), F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return days.filter("k = 24").select("series", "day", F.col("v.x").alias("shape"))


@query("a13_compounding", f"""WITH {SQL_RETURNS} SELECT series, round(exp(sum(ln(1 + ret / 100000))) - 1, 8) + 0.0 AS compounded, round(sum(ret / 100000), 8) + 0.0 AS summed FROM rets GROUP BY 1""")
def a13(t):
    ret = F.col("ret") / 100000
    return daily_returns(t).groupBy("series").agg(r(F.expm1(F.sum(F.log1p(ret))), 8).alias("compounded"), r(F.sum(ret), 8).alias("summed"))


@query("a14_segment_contrast", """SELECT o_orderstatus, round(avg(o_totalprice) FILTER (isodow(o_orderdate) >= 6) / avg(o_totalprice) FILTER (isodow(o_orderdate) < 6), 6) AS ratio,
round(100 * (1 - avg(o_totalprice) FILTER (isodow(o_orderdate) >= 6) / avg(o_totalprice) FILTER (isodow(o_orderdate) < 6)), 5) + 0.0 AS pct_reduction FROM orders GROUP BY 1""")
def a14(t):
    weekend = C.is_weekend(F.col("o_orderdate")) == 1
    on, off = F.avg(F.when(weekend, F.col("o_totalprice"))), F.avg(F.when(~weekend, F.col("o_totalprice")))
    return t.orders.groupBy("o_orderstatus").agg(r(on / off).alias("ratio"), r(100 * (1 - on / off), 5).alias("pct_reduction"))


@query("a15_histogram", """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 40), 39) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY 1""")
def a15(t):
    return profile.histogram(t.orders, "o_totalprice", 40)


@query("a15_histogram_2d", """WITH e AS (SELECT min(l_quantity) AS a0, max(l_quantity) AS a1, min(l_extendedprice) AS b0, max(l_extendedprice) AS b1 FROM lineitem)
SELECT CAST(least(floor((l_quantity - a0) / (a1 - a0) * 10), 9) AS BIGINT) AS bin_a, CAST(least(floor((l_extendedprice - b0) / (b1 - b0) * 12), 11) AS BIGINT) AS bin_b,
count(*) AS n FROM lineitem, e GROUP BY 1, 2""")
def a15b(t):
    return profile.histogram2d(t.lineitem, "l_quantity", "l_extendedprice", 10, 12)


@query("a16_ecdf", """SELECT event_type, value, round(max(c), 8) AS share FROM (SELECT event_type, value, cume_dist() OVER (PARTITION BY event_type ORDER BY value) AS c FROM events) GROUP BY 1, 2""")
def a16(t):
    return profile.ecdf(t.events, "value", ["event_type"]).withColumn("share", r("share", 8))


@query("a17_box_summary", """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3
FROM orders GROUP BY 1)
SELECT o_orderpriority, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS n_beyond
FROM orders JOIN q USING (o_orderpriority) GROUP BY 1, 2, 3, 4""")
def a17(t):
    b = profile.box_summary(t.orders, "o_totalprice", ["o_orderpriority"])
    return b.select("o_orderpriority", r("q1").alias("q1"), r("median").alias("median"), r("q3").alias("q3"), "n_beyond")


def _normal_quantile_sql(p):
    """SQL text of the same rational approximation the column function uses."""
    a = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
    b = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)

    def poly(k, x, tail=None):
        out = f"({k[0]!r})"
        for v in k[1:]:
            out = f"({out} * {x} + ({v!r}))"
        return out if tail is None else f"({out} * {x} + {tail})"

    q, lo, hi = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    sq = f"({q} * {q})"
    return (f"CASE WHEN {p} < 0.02425 THEN {poly(c, lo)} / {poly(d, lo, 1)} WHEN {p} > 1 - 0.02425 THEN -{poly(c, hi)} / {poly(d, hi, 1)} "
            f"ELSE {poly(a, sq)} * {q} / {poly(b, sq, 1)} END")


@query("a18_qq_points", f"""WITH o AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place, count(*) OVER () AS n FROM customer),
p AS (SELECT *, CASE WHEN place = 1 THEN 1 - pow(0.5, 1.0 / n) WHEN place = n THEN pow(0.5, 1.0 / n) ELSE (place - 0.3175) / (n + 0.365) END::DOUBLE AS p FROM o)
SELECT c_custkey, c_acctbal, place, round(p, 8) AS p, round({_normal_quantile_sql('p')}, 6) + 0.0 AS theoretical FROM p""")
def a18(t):
    q = profile.qq_points(t.customer, "c_acctbal", "c_custkey")
    return q.select("c_custkey", "c_acctbal", "place", r("p", 8).alias("p"), r("theoretical").alias("theoretical"))


@query("a19_exceedance_curve", """SELECT o_orderkey, o_totalprice, round((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) * 100.0 / count(*) OVER (), 6) AS pct_exceeding FROM orders""")
def a19(t):
    c = profile.exceedance_curve(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"])
    return c.select("o_orderkey", "o_totalprice", r("pct_exceeding").alias("pct_exceeding"))


@query("a20_cluster_summary", """SELECT label, count(*) AS n, round(avg(embedding[1]), 6) + 0.0 AS m1, round(avg(embedding[2]), 6) + 0.0 AS m2, round(stddev_samp(embedding[1]), 6) AS s1
FROM embeddings GROUP BY 1""")
def a20(t):
    e1, e2 = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), r(F.avg(e1)).alias("m1"), r(F.avg(e2)).alias("m2"), r(F.stddev_samp(e1)).alias("s1"))


# ------------------------------------------------------------------ statistical profile


@query("t1_jarque_bera", """WITH g AS (SELECT event_type, count(*) AS n, avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS g1,
avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) - 3 AS g2 FROM events JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) USING (event_type) GROUP BY 1)
SELECT event_type, round(n / 6.0 * (g1 * g1 + g2 * g2 / 4), 3) AS jb FROM g""")
def t1(t):
    return profile.normality(t.events, "value", ["event_type"]).select("event_type", r("jb", 3).alias("jb"))


@query("t2_dagostino", """WITH b AS (SELECT event_type, count(*)::DOUBLE AS n, avg(value) AS m FROM events GROUP BY 1),
g AS (SELECT event_type, any_value(n) AS n, avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS g1, avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) AS b2
      FROM events JOIN b USING (event_type) GROUP BY 1),
s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
      (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS x,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM g),
u AS (SELECT *, -1 + sqrt(2 * (beta - 1)) AS w2, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS a FROM s),
z AS (SELECT event_type, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs,
      (1 - 2 / (9 * a) - sign((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))) * pow(abs((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))), 1.0 / 3)) / sqrt(2 / (9 * a)) AS zk FROM u)
SELECT event_type, round(zs * zs + zk * zk, 4) AS k2 FROM z""")
def t2(t):
    return profile.normality(t.events, "value", ["event_type"]).select("event_type", r("k2", 4).alias("k2"))


@query("t3_outlier_flags", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
m AS (SELECT event_type, quantile_cont(abs(value - med), 0.5) AS mad FROM events JOIN q USING (event_type) GROUP BY 1)
SELECT event_type, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS iqr_flagged, count(*) FILTER (abs(0.6745 * (value - med) / mad) > 3.5) AS mad_flagged,
round(100.0 * count(*) FILTER (abs(0.6745 * (value - med) / mad) > 3.5) / count(*), 6) AS mad_pct FROM events JOIN q USING (event_type) JOIN m USING (event_type) GROUP BY 1""")
def t3(t):
    rows = profile.outlier_flags(t.events.select("event_id", "event_type", "value"), "value", ["event_type"])
    return rows.groupBy("event_type").agg(F.count_if("iqr_outlier").alias("iqr_flagged"), F.count_if("mad_outlier").alias("mad_flagged"),
                                          r(F.avg(F.col("mad_outlier").cast("double")) * 100).alias("mad_pct"))


@query("t4_pearson", """SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 8) + 0.0 AS coef FROM lineitem GROUP BY 1""")
def t4(t):
    return assoc.pearson(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "n", r("coef", 8).alias("coef"))


@query("t4_pearson_p")
def t4p(t):
    return assoc.pearson(t.lineitem, "l_quantity", "l_discount", ["l_returnflag"])


@query("t5_spearman", """WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS ra,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS rb FROM lineitem)
SELECT l_returnflag, round(corr(ra, rb), 7) + 0.0 AS coef FROM k GROUP BY 1""")
def t5(t):
    return assoc.spearman(t.lineitem, "l_quantity", "l_discount", ["l_returnflag"]).select("l_returnflag", r("coef", 7).alias("coef"))


@query("t6_kendall", """WITH c AS (SELECT l_quantity AS a, l_discount AS b, count(*) AS w FROM lineitem GROUP BY 1, 2),
p AS (SELECT CAST(sum(x.w * y.w) FILTER (x.b < y.b) AS BIGINT) AS concordant, CAST(sum(x.w * y.w) FILTER (x.b > y.b) AS BIGINT) AS discordant FROM c x JOIN c y ON x.a < y.a),
n AS (SELECT count(*)::DOUBLE AS n FROM lineitem), ta AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT count(*)::DOUBLE AS k FROM lineitem GROUP BY l_quantity)),
tb AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT count(*)::DOUBLE AS k FROM lineitem GROUP BY l_discount))
SELECT concordant, discordant, round((concordant - discordant) / sqrt((n * (n - 1) / 2 - ta.t) * (n * (n - 1) / 2 - tb.t)), 8) + 0.0 AS tau_b FROM p, n, ta, tb""")
def t6(t):
    return assoc.kendall(t.lineitem, "l_quantity", "l_discount").select("concordant", "discordant", r("tau_b", 8).alias("tau_b"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _matrix_sql(cols, table):
    cells = [f"SELECT '{a}' AS a, '{b}' AS b, " + (f"round(corr({a}, {b}), 7) + 0.0 AS c FROM {table}" if a != b else "1.0::DOUBLE AS c")
             for a in cols for b in cols]
    return " UNION ALL ".join(cells)


@query("t7_correlation_matrix", _matrix_sql(_NUM, "lineitem"))
def t7(t):
    return assoc.correlation_matrix(t.lineitem, _NUM).withColumn("c", r("c", 7))


@query("t7_mean_off_diagonal", f"""WITH {SQL_RETURNS}, p AS (SELECT corr(a.ret, b.ret) AS c FROM rets a JOIN rets b ON a.pos = b.pos AND a.series < b.series GROUP BY a.series, b.series)
SELECT count(*) AS pairs, round(avg(c), 7) + 0.0 AS mean_c FROM p""")
def t7m(t):
    return assoc.pair_correlations(daily_returns(t), "series", "pos", "ret").agg(F.count("*").alias("pairs"), r(F.avg("c"), 7).alias("mean_c"))


@query("t8_target_ranking", """SELECT feature, round(c, 7) + 0.0 AS corr FROM (SELECT 'l_quantity' AS feature, corr(l_quantity, l_extendedprice) AS c FROM lineitem
UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem
UNION ALL SELECT 'p_size', corr(p_size, l_extendedprice) FROM lineitem JOIN part ON l_partkey = p_partkey) ORDER BY abs(c) DESC""")
def t8(t):
    rows = t.lineitem.select("l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    return assoc.target_ranking(rows, ["l_quantity", "l_discount", "l_tax", "p_size"], "l_extendedprice").withColumn("corr", r("corr", 7))


@query("t9_cramers_v", """WITH d AS (SELECT l_returnflag AS a, CAST(l_linenumber AS VARCHAR) AS b FROM lineitem), c AS (SELECT a, b, count(*)::DOUBLE AS o FROM d GROUP BY 1, 2),
n AS (SELECT sum(o) AS n, count(DISTINCT a)::DOUBLE AS r, count(DISTINCT b)::DOUBLE AS k FROM c), ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), rb AS (SELECT b, sum(o) AS rb FROM c GROUP BY 1),
x AS (SELECT sum(pow(coalesce(o, 0) - ra * rb / n, 2) / (ra * rb / n)) AS chi2 FROM ra CROSS JOIN rb CROSS JOIN n LEFT JOIN c ON c.a = ra.a AND c.b = rb.b)
SELECT round(chi2, 6) AS chi2, round(sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / (least(k - pow(k - 1, 2) / (n - 1), r - pow(r - 1, 2) / (n - 1)) - 1)), 7) + 0.0 AS v FROM x, n""")
def t9(t):
    rows = t.lineitem.select("l_returnflag", F.col("l_linenumber").cast("string").alias("line"))
    return assoc.cramers_v(rows, "l_returnflag", "line").select(r("chi2").alias("chi2"), r("v", 7).alias("v"))


@query("t9_cramers_v_yates", """WITH d AS (SELECT o_orderstatus = 'F' AS a, o_totalprice > 250000 AS b FROM orders), c AS (SELECT a, b, count(*)::DOUBLE AS o FROM d GROUP BY 1, 2),
n AS (SELECT sum(o) AS n FROM c), ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), rb AS (SELECT b, sum(o) AS rb FROM c GROUP BY 1)
SELECT round(sum(pow(greatest(abs(coalesce(o, 0) - ra * rb / n) - 0.5, 0), 2) / (ra * rb / n)), 6) + 0.0 AS chi2 FROM ra CROSS JOIN rb CROSS JOIN n LEFT JOIN c ON c.a = ra.a AND c.b = rb.b""")
def t9y(t):
    rows = t.orders.select((F.col("o_orderstatus") == "F").alias("a"), (F.col("o_totalprice") > 250000).alias("b"))
    return assoc.cramers_v(rows, "a", "b").select(r("chi2").alias("chi2"))


_PAIRS = (("l_returnflag", "l_linestatus"), ("l_returnflag", "line"), ("l_linestatus", "line"))


@query("t9_cramers_matrix", "WITH d AS (SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem) " + " UNION ALL ".join(f"""
SELECT '{a}' AS a, '{b}' AS b, round(sqrt(greatest(0, chi2 / n - (k - 1) * (q - 1) / (n - 1)) / (least(k - pow(k - 1, 2) / (n - 1), q - pow(q - 1, 2) / (n - 1)) - 1)), 7) + 0.0 AS v FROM (
SELECT sum(pow(coalesce(o, 0) - ra * rb / n, 2) / (ra * rb / n)) AS chi2, any_value(n) AS n, count(DISTINCT x)::DOUBLE AS q, count(DISTINCT y)::DOUBLE AS k
FROM (SELECT {a} AS x, count(*)::DOUBLE AS ra FROM d GROUP BY 1) CROSS JOIN (SELECT {b} AS y, count(*)::DOUBLE AS rb FROM d GROUP BY 1) CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM d)
LEFT JOIN (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS o FROM d GROUP BY 1, 2) USING (x, y))""" for a, b in _PAIRS))
def t9m(t):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string").alias("line"))
    return assoc.cramers_v_matrix(rows, ["l_returnflag", "l_linestatus", "line"]).select("a", "b", r("v", 7).alias("v"))


@query("t10_vif", """WITH c AS (SELECT corr(l_quantity, charge) AS a, corr(l_quantity, l_discount) AS b, corr(charge, l_discount) AS c FROM
(SELECT l_quantity, l_discount, l_extendedprice * (1 - l_discount) AS charge FROM lineitem)), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c)
SELECT 'l_quantity' AS feature, round((1 - c * c) / det, 6) AS vif FROM d UNION ALL SELECT 'charge', round((1 - b * b) / det, 6) FROM d
UNION ALL SELECT 'l_discount', round((1 - a * a) / det, 6) FROM d""")
def t10(t):
    rows = t.lineitem.select("l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("charge"), "l_discount")
    return assoc.vif(rows, ["l_quantity", "charge", "l_discount"]).withColumn("vif", r("vif"))


@query("t11_mutual_information", f"""WITH d AS (SELECT event_type AS a, {SQL_BAND} AS b FROM events), c AS (SELECT a, b, count(*)::DOUBLE AS o FROM d GROUP BY 1, 2),
n AS (SELECT sum(o) AS n FROM c), ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), rb AS (SELECT b, sum(o) AS rb FROM c GROUP BY 1)
SELECT round(sum(o / n * ln(o * n / (ra * rb))), 8) + 0.0 AS mi FROM c JOIN ra USING (a) JOIN rb USING (b), n""")
def t11(t):
    return assoc.mutual_information(t.events, "event_type", C.bins(F.col("value"), AQI_EDGES, AQI_BANDS)).select(r("mi", 8).alias("mi"))


@query("t12_point_biserial", "SELECT round(corr(l_extendedprice, CAST(l_returnflag = 'R' AS INTEGER)), 8) + 0.0 AS coef FROM lineitem")
def t12(t):
    return t.lineitem.agg(r(F.corr("l_extendedprice", (F.col("l_returnflag") == "R").cast("double")), 8).alias("coef"))


@query("t13_ks_two_sample", """WITH c AS (SELECT value AS v, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type <> 'click') AS b FROM events GROUP BY 1),
s AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM c)
SELECT round(max(abs(fa - fb)), 8) AS ks FROM s""")
def t13(t):
    rows = t.events.select("value", (F.col("event_type") == "click").alias("is_click"))
    return profile.ks_two_sample(rows, "value", "is_click").select(r("ks", 8).alias("ks"))


@query("t13_ks_p_value", """WITH c AS (SELECT value AS v, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type <> 'click') AS b FROM events GROUP BY 1),
s AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c),
l AS (SELECT sqrt(any_value(na) * any_value(nb) / (any_value(na) + any_value(nb))) * max(abs(fa - fb)) AS lam FROM s)
SELECT round(CASE WHEN lam < 0.2 THEN 1.0 ELSE least(greatest((SELECT sum(2.0::DOUBLE * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * k * k * lam * lam)) FROM range(1, 51) g(k)), 0), 1) END, 8) AS p FROM l""")
def t13p(t):
    rows = t.events.select("value", (F.col("event_type") == "click").alias("is_click"))
    one = profile.ks_two_sample(rows, "value", "is_click")
    return one.select(r(profile.ks_p_value(F.col("ks"), F.col("n_flagged"), F.col("n_rest")), 8).alias("p"))


@query("t14_missingness_by_calendar", f"""WITH {SQL_HOURLY} SELECT series, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS slots, round(avg((y IS NULL)::INTEGER), 8) AS rate FROM hgrid GROUP BY 1, 2""")
def t14(t):
    return hourly_grid(t).groupBy("series", F.hour("ts").alias("hour")).agg(
        F.count("*").alias("slots"), r(F.avg(F.col("y").isNull().cast("int")), 8).alias("rate"))


@query("t15_gap_profile", f"""WITH {SQL_HOURLY}, isl AS (SELECT series, pos - row_number() OVER (PARTITION BY series ORDER BY pos) AS g FROM hgrid WHERE y IS NULL),
runs AS (SELECT series, count(*) AS k FROM isl GROUP BY series, g)
SELECT series, count(*) AS runs, round(quantile_cont(k, 0.5), 6) AS median_run, round(quantile_cont(k, 0.9), 6) AS p90_run, max(k) AS longest, round(avg((k <= 24)::INTEGER), 6) AS short_share FROM runs GROUP BY 1""")
def t15(t):
    runs = grid.run_table(hourly_grid(t), S, "pos", F.col("y").isNull())
    q = quantiles(runs, S, "run_length", {"median_run": 0.5, "p90_run": 0.9})
    rest = runs.groupBy("series").agg(F.count("*").alias("runs"), F.max("run_length").alias("longest"),
                                      r(F.avg((F.col("run_length") <= 24).cast("int"))).alias("short_share"))
    return rest.join(q, "series").select("series", "runs", r("median_run").alias("median_run"), r("p90_run").alias("p90_run"), "longest", "short_share")


@query("t16_skew_before_after", """SELECT 'raw' AS transform, round(skewness(value), 6) + 0.0 AS skew FROM events UNION ALL SELECT 'log1p', round(skewness(ln(1 + value)), 6) + 0.0 FROM events
UNION ALL SELECT 'sqrt', round(skewness(sqrt(value)), 6) + 0.0 FROM events""")
def t16(t):
    v = F.col("value")
    return profile.skew_table(t.events, {"raw": v, "log1p": F.log1p(v), "sqrt": F.sqrt(v)}).withColumn("skew", r("skew"))


@query("t17_exceedance_by_year", f"""WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice / 1000 AS value FROM orders)
SELECT year, {SQL_BAND} AS band, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY year), 8) AS share FROM o GROUP BY 1, 2""")
def t17(t):
    rows = t.orders.select(F.year("o_orderdate").alias("year"), C.bins(F.col("o_totalprice") / 1000, AQI_EDGES, AQI_BANDS).alias("band"))
    return profile.crosstab(rows, "year", "band").select("year", "band", "n", r(F.col("row_pct") / 100, 8).alias("share"))
