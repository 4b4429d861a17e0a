"""Queries: joins, alignment, window and sequence work."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import columns as C
from tidewright.functions.gridtime import floor_to, position, slot_start
from tidewright.operators import grid, risk
from tidewright.operators.ordering import attach, centred, lag_of, look_around, rolling, running, sorted_scan
from tidewright.plans.panels import (S, SQL_EWMA_PAIRS, SQL_FILLED, SQL_HOURLY, SQL_MONTHLY, SQL_RETURNS, daily_returns, hourly, hourly_filled, hourly_grid, monthly, r)
from tidewright.plans.registry import query


@query("j1_complete_grid", f"WITH {SQL_HOURLY} SELECT series, ts, n, y FROM hgrid")
def j1(t):
    return hourly_grid(t).select("series", "ts", "n", "y")


@query("j2_missing_slots", f"WITH {SQL_HOURLY} SELECT series, ts FROM hgrid WHERE y IS NULL")
def j2(t):
    return grid.missing_slots(hourly(t), S, "pos").select("series", slot_start(F.col("pos"), "hour").alias("ts"))


@query("j3_inner_alignment", """WITH a AS (SELECT o_orderdate AS ts, round(sum(o_totalprice), 2) AS ordered FROM orders GROUP BY 1),
b AS (SELECT l_shipdate AS ts, round(sum(l_extendedprice), 2) AS shipped FROM lineitem GROUP BY 1)
SELECT ts, ordered, shipped FROM a JOIN b USING (ts)""")
def j3(t):
    a = t.orders.groupBy(F.col("o_orderdate").alias("ts")).agg(r(F.sum("o_totalprice"), 2).alias("ordered"))
    b = t.lineitem.groupBy(F.col("l_shipdate").alias("ts")).agg(r(F.sum("l_extendedprice"), 2).alias("shipped"))
    return a.join(b, "ts")


@query("j4_bound_columns", f"""WITH {SQL_FILLED} SELECT series, ts, x, CAST(hour(ts) AS INTEGER) AS hour,
lag(x, 1) OVER w AS lag1, lag(x, 24) OVER w AS lag24 FROM filled WINDOW w AS (PARTITION BY series ORDER BY pos)""")
def j4(t):
    rows = look_around(hourly_filled(t), S, "pos", {"lag1": lag_of("x"), "lag24": lag_of("x", 24)})
    return rows.select("series", "ts", "x", F.hour("ts").alias("hour"), "lag1", "lag24")


@query("j5_calendar_lookup", f"""WITH {SQL_HOURLY}, clim AS (SELECT series, isodow(ts) AS d, hour(ts) AS h, avg(y) AS m FROM hgrid
WHERE y IS NOT NULL GROUP BY 1, 2, 3)
SELECT g.series, g.ts, round(coalesce(g.y, c.m), 6) AS v FROM hgrid g LEFT JOIN clim c
ON c.series = g.series AND c.d = isodow(g.ts) AND c.h = hour(g.ts)""")
def j5(t):
    rows = hourly_grid(t).withColumn("d", F.weekday("ts")).withColumn("h", F.hour("ts"))
    clim = rows.filter(F.col("y").isNotNull()).groupBy("series", "d", "h").agg(F.avg("y").alias("m"))
    return attach(rows, clim, ["series", "d", "h"], how="left").select("series", "ts", r(F.coalesce("y", "m")).alias("v"))


_FLOWS = """a AS (SELECT o_orderdate AS ts, round(sum(o_totalprice), 2) AS ordered FROM orders GROUP BY 1),
b AS (SELECT l_shipdate AS ts, round(sum(l_extendedprice), 2) AS shipped FROM lineitem GROUP BY 1)"""


def _flows(t):
    """Daily ordered and shipped amounts, each on its own day slots."""
    a = t.orders.groupBy(position(F.col("o_orderdate"), "day").alias("pos")).agg(r(F.sum("o_totalprice"), 2).alias("ordered"))
    b = t.lineitem.groupBy(position(F.col("l_shipdate"), "day").alias("pos")).agg(r(F.sum("l_extendedprice"), 2).alias("shipped"))
    return a, b


@query("j7_lag_alignment", f"""WITH {_FLOWS} SELECT a.ts, k, ordered, shipped FROM a CROSS JOIN generate_series(0, 3) AS g(k) JOIN b ON b.ts = a.ts + CAST(k AS INTEGER) * INTERVAL 1 DAY""")
def j7(t):
    a, b = _flows(t)
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))
    a = a.withColumn("ts", slot_start(F.col("pos"), "day")).withColumn("k", F.explode(slots)).withColumn("pos", F.col("pos") + F.col("k"))
    return a.join(b, "pos").select("ts", "k", "ordered", "shipped")


@query("j8_entity_pairs", f"""WITH {SQL_RETURNS} SELECT a.series AS a, b.series AS b, count(*) AS n,
round(corr(a.ret, b.ret), 6) + 0.0 AS c FROM rets a JOIN rets b ON a.pos = b.pos AND a.series < b.series GROUP BY 1, 2""")
def j8(t):
    from tidewright.operators.assoc import pair_correlations
    return pair_correlations(daily_returns(t), "series", "pos", "ret").select("a", "b", "n", r("c").alias("c"))


# ------------------------------------------------------------------ windows


@query("w1_lags", f"""WITH {SQL_FILLED} SELECT series, ts, lag(x, 1) OVER w AS l1, lag(x, 24) OVER w AS l24, lag(x, 168) OVER w AS l168
FROM filled WINDOW w AS (PARTITION BY series ORDER BY pos)""")
def w1(t):
    out = look_around(hourly_filled(t), S, "pos", {f"l{k}": lag_of("x", k) for k in (1, 24, 168)})
    return out.select("series", "ts", "l1", "l24", "l168")


@query("w2_differences", f"""WITH {SQL_FILLED} SELECT series, ts, round(x - lag(x, 1) OVER w, 6) + 0.0 AS d1, round(x - lag(x, 24) OVER w, 6) + 0.0 AS d24
FROM filled WINDOW w AS (PARTITION BY series ORDER BY pos)""")
def w2(t):
    out = look_around(hourly_filled(t), S, "pos", {"a": lag_of("x", 1), "b": lag_of("x", 24)})
    return out.select("series", "ts", r(F.col("x") - F.col("a")).alias("d1"), r(F.col("x") - F.col("b")).alias("d24"))


@query("w3_percent_change", f"""WITH {SQL_MONTHLY} SELECT series, ts, round(x / lag(x) OVER (PARTITION BY series ORDER BY ts) - 1, 8) + 0.0 AS chg FROM monthly""")
def w3(t):
    out = look_around(monthly(t), S, "pos", {"a": lag_of("x")})
    return out.select("series", "ts", r(C.ratio(F.col("x"), F.col("a")) - 1, 8).alias("chg"))


@query("w4_log_return", f"""WITH {SQL_MONTHLY} SELECT series, ts, round(ln(x) - ln(lag(x) OVER (PARTITION BY series ORDER BY ts)), 8) + 0.0 AS ret FROM monthly""")
def w4(t):
    out = look_around(monthly(t), S, "pos", {"a": lag_of("x")})
    return out.select("series", "ts", r(C.safe_log(F.col("x")) - C.safe_log(F.col("a")), 8).alias("ret"))


@query("w5_rolling_full_windows", f"""WITH {SQL_FILLED} SELECT series, ts, CASE WHEN count(x) OVER w = 24 THEN round(avg(x) OVER w, 7) END AS m24,
CASE WHEN count(x) OVER w = 24 THEN round(stddev_samp(x) OVER w, 5) END AS s24 FROM filled
WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def w5(t):
    out = look_around(hourly_filled(t), S, "pos", {"m": rolling("mean", "x", 24), "s": rolling("std", "x", 24)})
    return out.select("series", "ts", r("m", 7).alias("m24"), r("s", 5).alias("s24"))


@query("w6_lagged_rolling", f"""WITH {SQL_FILLED} SELECT series, ts, CASE WHEN count(x) OVER w = 24 THEN round(avg(x) OVER w, 7) END AS m,
CASE WHEN count(x) OVER w = 24 THEN round(stddev_samp(x) OVER w, 5) END AS s FROM filled
WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING)""")
def w6(t):
    out = look_around(hourly_filled(t), S, "pos", {"m": rolling("mean", "x", 24, 24), "s": rolling("std", "x", 24, 24)})
    return out.select("series", "ts", r("m", 7).alias("m"), r("s", 5).alias("s"))


@query("w7_cumulative_sum", f"""WITH {SQL_FILLED} SELECT series, ts, round(sum(x) OVER (PARTITION BY series ORDER BY pos), 4) AS cum FROM filled""")
def w7(t):
    return running(hourly_filled(t), S, "pos", sums={"cum": "x"}, block=256).select("series", "ts", r("cum", 4).alias("cum"))


@query("w8_fills", f"""WITH {SQL_HOURLY} SELECT series, ts, last_value(y IGNORE NULLS) OVER w AS forward, first_value(y IGNORE NULLS) OVER v AS backward
FROM hgrid WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
v AS (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def w8(t):
    rows = running(hourly_grid(t), S, "pos", last={"p": "y"}, following={"q": "y"})
    return rows.select("series", "ts", F.col("p.value").alias("forward"), F.col("q.value").alias("backward"))


@query("w9_interpolated", f"WITH {SQL_FILLED} SELECT series, ts, x FROM filled")
def w9(t):
    return hourly_filled(t).select("series", "ts", "x")


_RUNS = SQL_HOURLY + """,
isl AS (SELECT series, ts, pos, pos - row_number() OVER (PARTITION BY series ORDER BY pos) AS g FROM hgrid WHERE y IS NULL)"""


@query("w10_gap_runs", f"WITH {_RUNS} SELECT series, min(ts) AS start_ts, count(*) AS run_length FROM isl GROUP BY series, g")
def w10(t):
    runs = grid.run_table(hourly_grid(t), S, "pos", F.col("y").isNull())
    return runs.select("series", slot_start(F.col("run_start"), "hour").alias("start_ts"), "run_length")


@query("w11_run_length_per_point", f"WITH {_RUNS} SELECT series, ts, count(*) OVER (PARTITION BY series, g) AS run_length FROM isl")
def w11(t):
    rows = grid.mark_runs(hourly_grid(t), S, "pos", F.col("y").isNull())
    return rows.filter(F.col("y").isNull()).select("series", "ts", "run_length")


@query("w12_rank_by_value", """WITH b AS (SELECT p_brand, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_brand, p_type, n, row_number() OVER (ORDER BY n DESC, p_brand, p_type) AS place FROM b""")
def w12(t):
    cells = t.lineitem.select("l_partkey").join(t.part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    cells = cells.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return sorted_scan(cells, [], [F.desc("n"), F.col("p_brand"), F.col("p_type")], row_number="place")


_ROLLZ = SQL_FILLED + """, z AS (SELECT series, ts, CASE WHEN count(x) OVER w = 48 THEN round((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 5) + 0.0 END AS z
FROM filled WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))"""


def _rolling_z(t):
    rows = look_around(hourly_filled(t), S, "pos", {"m": rolling("mean", "x", 48), "s": rolling("std", "x", 48)})
    return rows.withColumn("z", r((F.col("x") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)), 5))


@query("w13_rolling_z", f"WITH {_ROLLZ} SELECT series, ts, z FROM z")
def w13(t):
    return _rolling_z(t).select("series", "ts", "z")


@query("w14_ewma_correlation", f"WITH {SQL_EWMA_PAIRS} SELECT ts, round(rho, 6) + 0.0 AS rho FROM rho")
def w14(t):
    out = risk.ewma_correlation(daily_returns(t), "series", "pos", "ret", lam=0.94)
    return out.select(slot_start(F.col("pos"), "day").alias("ts"), r("rho").alias("rho"))


@query("w15_ramp_and_peak", f"""WITH {SQL_FILLED}, d AS (SELECT *, x - lag(x) OVER (PARTITION BY series ORDER BY pos) AS ramp FROM filled)
SELECT series, date_trunc('day', ts) AS day, round(max(x) - min(x), 6) + 0.0 AS swing, round(max(ramp), 6) + 0.0 AS steepest, CAST(hour(arg_max(ts, struct_pack(x := x, p := -pos))) AS INTEGER) AS peak_hour
FROM d GROUP BY 1, 2""")
def w15(t):
    rows = look_around(hourly_filled(t), S, "pos", {"_l": lag_of("x")}).withColumn("ramp", F.col("x") - F.col("_l"))
    return rows.groupBy("series", floor_to(F.col("ts"), "day").alias("day")).agg(
        r(F.max("x") - F.min("x")).alias("swing"), r(F.max("ramp")).alias("steepest"),
        F.hour(F.max_by("ts", F.struct("x", -F.col("pos")))).alias("peak_hour"))


@query("w16_entry_signals", f"WITH {_ROLLZ} SELECT series, count(*) FILTER (abs(z) > 2) AS signals FROM z GROUP BY 1")
def w16(t):
    return _rolling_z(t).groupBy("series").agg(F.count_if(F.abs("z") > 2).alias("signals"))


@query("w5_centred_mean", f"""WITH {SQL_RETURNS} SELECT series, ts, CASE WHEN count(ret) OVER w = 7 THEN round(avg(ret) OVER w, 6) + 0.0 END AS c7
FROM rets WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def w5c(t):
    out = look_around(daily_returns(t), S, "pos", {"c": centred("mean", "ret", 3, 3)}, block=512)
    return out.select("series", "ts", r("c").alias("c7"))
