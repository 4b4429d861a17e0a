"""Shared inputs of the registered queries, each as a Spark plan and as SQL text.

* hourly panel: events per type and hour (``n`` rows, ``y`` summed value), with real gaps
* daily panel: orders per priority and day (``n`` orders, ``y`` mean price)
* monthly panel: line items per return flag and month (``y`` mean unit price)
* predictions: seasonal-naive and naive forecasts of the hourly panel, for scores
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.gridtime import position, slot_start
from tidewright.operators.grid import complete, interpolate
from tidewright.operators.ordering import lag_of, look_around
from tidewright.session import settle

S = ["series"]


def r(col, digits: int = 6):
    """Rounded result column; the added zero turns a negative zero into zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


# ------------------------------------------------------------------ hourly panel
def hourly(t) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("series"), position(F.col("ts"), "hour").alias("pos"), "value")
    return rows.groupBy("series", "pos").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("y"))


def hourly_grid(t) -> DataFrame:
    """Complete hourly grid with missing values in the real gaps.

    The panel is stored once it is aggregated: later branches read it instead of the source table.
    """
    return complete(settle(hourly(t)), S, "pos").withColumn("ts", slot_start(F.col("pos"), "hour"))


def hourly_filled(t) -> DataFrame:
    rows = interpolate(hourly_grid(t), S, "pos", "y", "x")
    return settle(rows.withColumn("x", F.round("x", 6)))


SQL_HOURLY = """
hourly AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, count(*) AS n, round(sum(value), 2) AS y
           FROM events GROUP BY 1, 2),
hends AS (SELECT series, min(ts) AS a, max(ts) AS b FROM hourly GROUP BY 1),
hslots AS (SELECT series, u.ts FROM hends, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS u(ts)),
hgrid AS (SELECT s.series, s.ts, h.n, h.y, CAST(epoch(s.ts) / 3600 AS BIGINT) AS pos
          FROM hslots s LEFT JOIN hourly h ON h.series = s.series AND h.ts = s.ts)"""
SQL_FILLED = SQL_HOURLY + """,
hmark AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS ppos,
                 last_value(y IGNORE NULLS) OVER w AS py,
                 first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER v AS npos,
                 first_value(y IGNORE NULLS) OVER v AS ny
          FROM hgrid WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                            v AS (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT series, ts, pos, n, y, round(CASE WHEN y IS NOT NULL THEN y WHEN ppos IS NULL THEN NULL
                  WHEN npos IS NULL THEN py ELSE py + (ny - py) * ((pos - ppos) / (npos - ppos)) END, 6) AS x FROM hmark)"""


# ------------------------------------------------------------------ daily panel
def daily(t) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("series"),
                           position(F.col("o_orderdate"), "day").alias("pos"), "o_totalprice")
    return rows.groupBy("series", "pos").agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("y"))


def daily_filled(t) -> DataFrame:
    rows = interpolate(complete(settle(daily(t)), S, "pos"), S, "pos", "y", "x")
    return settle(rows.withColumn("x", F.round("x", 6)).withColumn("ts", slot_start(F.col("pos"), "day")))


def daily_returns(t) -> DataFrame:
    """Log returns of the daily mean price in per cent."""
    rows = look_around(daily_filled(t), S, "pos", {"_l": lag_of("x", 1)})
    return settle(rows.withColumn("ret", F.round((F.log("x") - F.log("_l")) * 100, 6)).filter(F.col("ret").isNotNull())
                  .select("series", "pos", "ts", "x", "ret"))


SQL_DAILY = """
daily AS (SELECT o_orderpriority AS series, o_orderdate AS ts, count(*) AS n, round(avg(o_totalprice), 6) AS y
          FROM orders GROUP BY 1, 2),
dends AS (SELECT series, min(ts) AS a, max(ts) AS b FROM daily GROUP BY 1),
dslots AS (SELECT series, u.ts FROM dends, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS u(ts)),
dgrid AS (SELECT s.series, s.ts, d.n, d.y, CAST(epoch(s.ts) / 86400 AS BIGINT) AS pos
          FROM dslots s LEFT JOIN daily d ON d.series = s.series AND d.ts = s.ts),
dmark AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS ppos,
                 last_value(y IGNORE NULLS) OVER w AS py,
                 first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER v AS npos,
                 first_value(y IGNORE NULLS) OVER v AS ny
          FROM dgrid WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                            v AS (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
dfilled AS (SELECT series, ts, pos, n, y, round(CASE WHEN y IS NOT NULL THEN y ELSE
                   py + (ny - py) * ((pos - ppos) / (npos - ppos)) END, 6) AS x FROM dmark)"""
SQL_RETURNS = SQL_DAILY + """,
rets AS (SELECT * FROM (SELECT series, ts, pos, x,
                round((ln(x) - ln(lag(x) OVER (PARTITION BY series ORDER BY pos))) * 100, 6) AS ret FROM dfilled)
         WHERE ret IS NOT NULL)"""


# exponentially weighted covariance of every pair on common days; the factor 0.94^i cancels in the correlation
SQL_EWMA_PAIRS = SQL_RETURNS + """,
al AS (SELECT *, dense_rank() OVER (ORDER BY pos) AS i FROM rets WHERE pos IN (SELECT pos FROM rets GROUP BY 1 HAVING count(*) = 5)),
pr AS (SELECT a.series AS sa, b.series AS sb, a.ts, a.i, a.ret * b.ret AS xy, a.ret AS x, b.ret AS y FROM al a JOIN al b ON a.pos = b.pos AND a.series <= b.series),
sd AS (SELECT sa, sb, covar_samp(x, y) AS s FROM pr GROUP BY 1, 2),
cv AS (SELECT sa, sb, ts, s + 0.06 * sum(xy * pow(0.94, -i)) OVER (PARTITION BY sa, sb ORDER BY i) AS c FROM pr JOIN sd USING (sa, sb)),
rho AS (SELECT o.ts, avg(o.c / sqrt(p.c * q.c)) AS rho FROM cv o JOIN cv p ON p.sa = o.sa AND p.sb = o.sa AND p.ts = o.ts
        JOIN cv q ON q.sa = o.sb AND q.sb = o.sb AND q.ts = o.ts WHERE o.sa < o.sb GROUP BY 1)"""


# ------------------------------------------------------------------ monthly panel
def monthly(t) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("series"), position(F.col("l_shipdate"), "month").alias("pos"),
                             (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    out = rows.groupBy("series", "pos").agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("x"))
    return out.withColumn("ts", slot_start(F.col("pos"), "month"))


SQL_MONTHLY = """
monthly AS (SELECT l_returnflag AS series, date_trunc('month', l_shipdate) AS ts,
                   CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS pos,
                   count(*) AS n, round(avg(l_extendedprice / l_quantity), 4) AS x
            FROM lineitem GROUP BY 1, 2, 3)"""


# ------------------------------------------------------------------ predictions for scores
TEST_HOURS = 168


def predictions(t) -> DataFrame:
    """Filled hourly panel with two lag forecasts; ``part`` is test for the last week of each series."""
    rows = look_around(hourly_filled(t), S, "pos", {"p24": lag_of("x", 24), "p168": lag_of("x", 168)})
    ends = rows.groupBy("series").agg((F.max("pos") - TEST_HOURS).alias("cut"))
    return rows.join(ends, "series").withColumn("part", F.when(F.col("pos") > F.col("cut"), "test").otherwise("train"))


SQL_PREDICTIONS = SQL_FILLED + f""",
preds AS (SELECT *, CASE WHEN pos > max(pos) OVER (PARTITION BY series) - {TEST_HOURS} THEN 'test' ELSE 'train' END AS part
          FROM (SELECT *, lag(x, 24) OVER (PARTITION BY series ORDER BY pos) AS p24,
                       lag(x, 168) OVER (PARTITION BY series ORDER BY pos) AS p168 FROM filled))"""
