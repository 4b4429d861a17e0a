"""Queries: scans, sinks, cleaning, audits, projections, resampling and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import columns as C
from tidewright.functions.gridtime import day_plus_hour, floor_to, from_parts, position, slot_start
from tidewright.functions.holidays import holiday_table, us_holidays
from tidewright.operators import clean, grid
from tidewright.operators.ordering import lag_of, look_around, quantiles
from tidewright.plans.panels import (S, SQL_DAILY, SQL_FILLED, SQL_HOURLY, SQL_MONTHLY, daily, hourly, hourly_filled,
                                     hourly_grid, monthly, r)
from tidewright.plans.registry import query
from tidewright.sources import files

# ------------------------------------------------------------------ scans and sinks


@query("s1_csv_scan", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1")
def s1(t):
    path = files.write_csv(t.lineitem.select("l_orderkey", "l_returnflag", "l_quantity"),
                           files.scratch(t.spark, "lineitem-csv"))
    rows = files.read_csv(t.spark, path, "l_orderkey bigint, l_returnflag string, l_quantity double")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("qty"))


@query("s2_csv_dated_scan", """SELECT o_orderdate AS ts, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price
FROM orders GROUP BY 1""")
def s2(t):
    path = files.write_csv(t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"),
                                           "o_totalprice"), files.scratch(t.spark, "orders-csv"))
    rows = files.read_csv(t.spark, path, "stamp timestamp_ntz, o_totalprice double", "yyyy-MM-dd HH:mm:ss")
    return rows.groupBy(F.col("stamp").alias("ts")).agg(
        F.count("*").alias("n"), r(F.avg("o_totalprice"), 6).alias("mean_price"))


@query("s3_reread_intermediate", f"""WITH {SQL_HOURLY} SELECT series, count(*) AS slots,
count(y) AS known FROM hgrid GROUP BY 1""")
def s3(t):
    path = files.write_table(hourly_grid(t), files.scratch(t.spark, "hourly-grid"))
    rows = t.spark.read.parquet(path)
    return rows.groupBy("series").agg(F.count("*").alias("slots"), F.count("y").alias("known"))


@query("s4_partitioned_sink", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n,
round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1""")
def s4(t):
    rows = t.orders.withColumn("year", F.year("o_orderdate"))
    path = files.write_table(rows, files.scratch(t.spark, "orders-by-year"), ["year"])
    back = t.spark.read.parquet(path).filter("year >= 1998")
    return back.groupBy("year").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("s5_imputed_sink_with_flag", f"""WITH {SQL_FILLED} SELECT series, y IS NULL AS was_imputed, count(*) AS n,
round(sum(x), 4) AS total FROM filled GROUP BY 1, 2""")
def s5(t):
    rows = hourly_filled(t).select("series", "pos", "x", F.col("y").isNull().alias("was_imputed"))
    path = files.write_table(rows, files.scratch(t.spark, "imputed"), ["series"])
    back = t.spark.read.parquet(path)
    return back.groupBy("series", "was_imputed").agg(F.count("*").alias("n"), r(F.sum("x"), 4).alias("total"))


@query("s6_weekly_to_monthly", """WITH wk AS (SELECT date_trunc('week', o_orderdate) AS w, avg(o_totalprice) AS y
FROM orders GROUP BY 1)
SELECT date_trunc('month', w) AS ts, count(*) AS weeks, round(avg(y), 4) AS mean_y FROM wk GROUP BY 1""")
def s6(t):
    weekly = grid.resample(t.orders, [], "o_orderdate", "week", [F.avg("o_totalprice").alias("y")])
    return grid.resample(weekly, [], "ts", "month", [F.count("*").alias("weeks"), r(F.avg("y"), 4).alias("mean_y")])


# ------------------------------------------------------------------ cleaning
_P_TEXT = "CASE WHEN p_size % 7 = 0 THEN ' ' ELSE CAST(p_retailprice AS VARCHAR) END"


def _part_text(t):
    """Parts with a price kept as text and blank for some sizes, as a billing export would hold it."""
    text = F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_retailprice").cast("string"))
    return t.part.withColumn("raw", text).withColumn("price", C.to_number(F.col("raw")))


@query("p1_text_to_number", f"""SELECT p_partkey, TRY_CAST(trim({_P_TEXT}) AS DOUBLE) AS price FROM part""")
def p1(t):
    return _part_text(t).select("p_partkey", "price")


@query("p2_coercion_failures", f"""SELECT p_size, count(*) AS n_failed FROM part
WHERE TRY_CAST(trim({_P_TEXT}) AS DOUBLE) IS NULL GROUP BY 1""")
def p2(t):
    return clean.coercion_failures(_part_text(t), "raw", "price", "p_size")


@query("p3_constant_fill", f"""SELECT p_type, round(sum(coalesce(TRY_CAST(trim({_P_TEXT}) AS DOUBLE), 0)), 2) AS total
FROM part GROUP BY 1""")
def p3(t):
    return _part_text(t).na.fill(0.0, ["price"]).groupBy("p_type").agg(r(F.sum("price"), 2).alias("total"))


@query("p4_sentinel_to_missing", """SELECT l_returnflag, count(nullif(l_discount, 0)) AS known,
round(avg(nullif(l_discount, 0)), 8) AS mean_known FROM lineitem GROUP BY 1""")
def p4(t):
    d = C.zero_is_missing(F.col("l_discount"))
    return t.lineitem.groupBy("l_returnflag").agg(F.count(d).alias("known"), r(F.avg(d), 8).alias("mean_known"))


@query("p5_sentinel_audit", """SELECT 'l_discount' AS check_name, count(*) FILTER (l_discount = 0) AS n FROM lineitem
UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax = 0) FROM lineitem
UNION ALL SELECT 'l_quantity', count(*) FILTER (l_quantity = 0) FROM lineitem""")
def p5(t):
    return clean.audit(t.lineitem, {c: F.col(c) == 0 for c in ("l_discount", "l_tax", "l_quantity")})


STATUS = {"F": "filled", "O": "open", "P": "partial"}


@query("p6_code_to_label", """SELECT CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open'
WHEN 'P' THEN 'partial' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def p6(t):
    return t.orders.groupBy(C.label(F.col("o_orderstatus"), STATUS).alias("status")).agg(F.count("*").alias("n"))


@query("p7_categorical_codes", """SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE)
AS code, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def p7(t):
    from pyspark.ml.feature import StringIndexer
    model = StringIndexer(inputCol="o_orderpriority", outputCol="code",
                          stringOrderType="alphabetAsc").fit(t.orders.select("o_orderpriority"))
    return model.transform(t.orders).groupBy("o_orderpriority", "code").agg(F.count("*").alias("n"))


@query("p8_indicator", """SELECT l_linestatus, CAST(sum(CAST(l_returnflag = 'R' AS BIGINT)) AS BIGINT) AS returned FROM lineitem GROUP BY 1""")
def p8(t):
    return t.lineitem.groupBy("l_linestatus").agg(F.sum((F.col("l_returnflag") == "R").cast("int")).alias("returned"))


@query("p9_drop_leakage", """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice AS target
FROM lineitem""")
def p9(t):
    leaky = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate"]
    return t.lineitem.drop(*leaky).withColumnRenamed("l_extendedprice", "target")


@query("p10_tidy_headers", "SELECT s_suppkey AS id, lower(trim(s_name)) AS name, s_nationkey, s_acctbal FROM supplier")
def p10(t):
    messy = t.supplier.withColumnsRenamed({"s_suppkey": " S_SuppKey", "s_name": "S_NAME "})
    return files.tidy_header(messy, {"s_suppkey": "id", "s_name": "name"}).withColumn("name", F.lower(F.trim("name")))


@query("p11_unit_restoration", "SELECT l_orderkey, l_linenumber, l_discount * 100 AS discount_pct, l_tax * 41 AS scaled FROM lineitem")
def p11(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 100).alias("discount_pct"),
                             (F.col("l_tax") * 41).alias("scaled"))


@query("p12_timestamp_from_parts", """SELECT event_id, date_trunc('hour', ts) AS stamp, date_trunc('day', ts) AS day_stamp
FROM events""")
def p12(t):
    ts = F.col("ts")
    return t.events.select("event_id", day_plus_hour(F.to_date(ts), F.hour(ts)).alias("stamp"),
                           from_parts(F.year(ts), F.month(ts), F.dayofmonth(ts)).alias("day_stamp"))


@query("p13_derived_features", """SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0), 8) AS unit_price,
round(l_discount / (l_tax + 1), 8) AS discount_ratio, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
l_quantity - l_linenumber AS gap FROM lineitem""")
def p13(t):
    price, d, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", r(C.ratio(price, F.col("l_quantity")), 8).alias("unit_price"),
                             r(d / (tax + 1), 8).alias("discount_ratio"), r(price * (1 - d) * (1 + tax), 6).alias("charge"),
                             (F.col("l_quantity") - F.col("l_linenumber")).alias("gap"))


@query("p14_value_transforms", """SELECT event_id, round(ln(value), 6) + 0.0 AS log_v, round(ln(1 + value), 6) AS log1p_v,
round(sqrt(value), 6) AS sqrt_v, round(exp(ln(1 + value)) - 1, 6) AS back_v, least(greatest(value, 5.0), 100.0) AS clipped FROM events""")
def p14(t):
    v = F.col("value")
    log1p = F.when(v > -1, F.log1p(v)).otherwise(C.ieee_log(1 + v))
    return t.events.select("event_id", r(C.ieee_log(v)).alias("log_v"), r(log1p).alias("log1p_v"),
                           r(F.sqrt(v)).alias("sqrt_v"), r(F.expm1(log1p)).alias("back_v"),
                           C.clip(v, 5.0, 100.0).alias("clipped"))


# Air-quality band edges and names.
AQI_EDGES = (-0.1, 12, 35.4, 55.4, 150.4, 250.4, float("inf"))
AQI_BANDS = ("Good", "Moderate", "Unhealthy(sens)", "Unhealthy", "Very unhealthy", "Hazardous")
SQL_BAND = """CASE WHEN value > -0.1 AND value <= 12 THEN 'Good' WHEN value <= 35.4 THEN 'Moderate'
WHEN value <= 55.4 THEN 'Unhealthy(sens)' WHEN value <= 150.4 THEN 'Unhealthy' WHEN value <= 250.4 THEN 'Very unhealthy'
WHEN value > 250.4 THEN 'Hazardous' END"""


@query("p15_fixed_bins", f"SELECT {SQL_BAND} AS band, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def p15(t):
    band = C.bins(F.col("value"), AQI_EDGES, AQI_BANDS)
    return t.events.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("p16_quantile_bins", """WITH e AS (SELECT quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS q FROM events)
SELECT CAST((value > q[1])::INT + (value > q[2])::INT + (value > q[3])::INT + (value > q[4])::INT AS BIGINT) AS bin, count(*) AS n,
min(value) AS lo, max(value) AS hi FROM events, e GROUP BY 1""")
def p16(t):
    edges = quantiles(t.events, [], "value", {"q1": .2, "q2": .4, "q3": .6, "q4": .8})
    from tidewright.operators.ordering import attach
    rows = attach(t.events.select("value"), edges)
    number = sum(((F.col("value") > F.col(q)).cast("bigint") for q in ("q1", "q2", "q3", "q4")), F.lit(0))
    return rows.groupBy(number.cast("bigint").alias("bin")).agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("p17_row_filters", """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01'
AND TIMESTAMP '1997-06-30' AND o_orderstatus IN ('F', 'P') AND o_totalprice > 250000""")
def p17(t):
    return t.orders.filter(
        F.col("o_orderdate").between(F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"), F.lit("1997-06-30 00:00:00").cast("timestamp_ntz"))
        & F.col("o_orderstatus").isin("F", "P") & (F.col("o_totalprice") > 250000)
    ).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("p18_identity_check", f"""WITH {SQL_HOURLY}, pooled AS (SELECT date_trunc('hour', ts) AS ts, count(*) AS total FROM events GROUP BY 1),
parts AS (SELECT ts, CAST(sum(n) AS BIGINT) AS parts FROM hourly GROUP BY 1)
SELECT count(*) AS slots, bool_and(total = parts) AS holds FROM pooled JOIN parts USING (ts)""")
def p18(t):
    pooled = t.events.groupBy(position(F.col("ts"), "hour").alias("pos")).agg(F.count("*").alias("total"))
    parts = hourly(t).groupBy("pos").agg(F.sum("n").alias("parts"))
    return pooled.join(parts, "pos").agg(F.count("*").alias("slots"), F.bool_and(F.col("total") == F.col("parts")).alias("holds"))


@query("p19_range_audit", """SELECT 'price_not_positive' AS check_name, count(*) FILTER (l_extendedprice <= 0) AS n FROM lineitem
UNION ALL SELECT 'discount_over_9pct', count(*) FILTER (l_discount > 0.09) FROM lineitem
UNION ALL SELECT 'quantity_out_of_range', count(*) FILTER (l_quantity NOT BETWEEN 1 AND 50) FROM lineitem
UNION ALL SELECT 'ship_after_2001', count(*) FILTER (l_shipdate >= TIMESTAMP '2001-01-01') FROM lineitem""")
def p19(t):
    return clean.audit(t.lineitem, {
        "price_not_positive": F.col("l_extendedprice") <= 0, "discount_over_9pct": F.col("l_discount") > 0.09,
        "quantity_out_of_range": ~F.col("l_quantity").between(1, 50),
        "ship_after_2001": F.col("l_shipdate") >= F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")})


_DUP = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("p20_exact_copies", f"""SELECT {', '.join(_DUP)}, count(*) AS copies FROM lineitem GROUP BY ALL""")
def p20(t):
    return clean.exact_copies(t.lineitem, _DUP)


@query("p20_copies_summary", f"""SELECT count(*) AS distinct_rows, CAST(sum(copies - 1) AS BIGINT) AS surplus_rows, max(copies) AS most_copies
FROM (SELECT text, lang, count(*) AS copies FROM documents GROUP BY 1, 2)""")
def p20s(t):
    return clean.exact_copies(t.documents, ["text", "lang"], digest=["text"]).agg(
        F.count("*").alias("distinct_rows"), F.sum(F.col("copies") - 1).alias("surplus_rows"), F.max("copies").alias("most_copies"))


@query("p21_keep_first", """SELECT o_orderdate, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderdate
ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1""")
def p21(t):
    return clean.keep_first(t.orders.select("o_orderdate", "o_orderkey", "o_totalprice"), ["o_orderdate"], ["o_orderkey"])


@query("p22_drop_missing", f"""WITH {SQL_HOURLY} SELECT series, count(*) AS kept FROM hgrid WHERE y IS NOT NULL GROUP BY 1""")
def p22(t):
    return hourly_grid(t).na.drop(subset=["y"]).groupBy("series").agg(F.count("*").alias("kept"))


@query("p23_standardise", """SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) + 0.0
AS price_z FROM orders""")
def p23(t):
    return clean.standardise(t.orders, ["o_totalprice"]).select("o_orderkey", r("o_totalprice_z").alias("price_z"))


@query("p23_standardise_by_key", """SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w, 6) + 0.0
AS price_z FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""")
def p23k(t):
    return clean.standardise(t.orders, ["o_totalprice"], ["o_orderpriority"]).select("o_orderkey", r("o_totalprice_z").alias("price_z"))


@query("p24_day_shape", f"""WITH {SQL_FILLED}, d AS (SELECT series, date_trunc('day', ts) AS day, hour(ts) AS hour, x,
avg(x) OVER w AS m, stddev_pop(x) OVER w AS s, count(x) OVER w AS k FROM filled WINDOW w AS (PARTITION BY series, date_trunc('day', ts)))
SELECT series, day, CAST(hour AS INTEGER) AS hour, round((x - m) / nullif(s, 0), 6) + 0.0 AS z FROM d WHERE k = 24""")
def p24(t):
    rows = hourly_filled(t).withColumn("day", floor_to(F.col("ts"), "day")).withColumn("hour", F.hour("ts"))
    full = rows.groupBy("series", "day").agg(F.count("x").alias("k"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    both = rows.join(full.filter("k = 24"), ["series", "day"])
    return both.select("series", "day", "hour", r((F.col("x") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).alias("z"))


@query("p25_rebased", f"""WITH {SQL_MONTHLY} SELECT series, ts, round(x / first_value(x) OVER (PARTITION BY series ORDER BY ts), 6) AS idx
FROM monthly""")
def p25(t):
    return clean.rebase(monthly(t), S, "pos", "x", "idx").select("series", "ts", r("idx").alias("idx"))


@query("p26_hash_sample", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY ((o_orderkey % 1000003) * 2654435761) % 1000003, o_orderkey LIMIT 500""")
def p26(t):
    return clean.hash_sample(t.orders.select("o_orderkey", "o_totalprice"), C.portable_hash(F.col("o_orderkey")), 500)


# ------------------------------------------------------------------ sorts, limits, sets, resampling


@query("r1_sorted_by_abs", """SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY abs(c_acctbal) DESC, c_custkey) AS place FROM customer""")
def r1(t):
    from tidewright.operators.ordering import sorted_scan
    rows = t.customer.select("c_custkey", "c_acctbal")
    return sorted_scan(rows, [], [F.abs("c_acctbal").desc(), F.col("c_custkey")], row_number="place")


@query("r2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def r2(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("r3_union_pieces", """SELECT o_orderkey AS id, o_totalprice AS amount, 'order' AS kind FROM orders
UNION ALL SELECT c_custkey, c_acctbal, 'customer' FROM customer""")
def r3(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.lit("order").alias("kind"))
    b = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.lit("customer").alias("kind"))
    return a.unionByName(b)


@query("r4_downsample_daily", f"""WITH {SQL_FILLED} SELECT series, date_trunc('day', ts) AS ts, round(avg(x), 6) AS mean_x, min(x) AS min_x, max(x) AS max_x,
arg_max(x, pos) AS last_x FROM filled GROUP BY 1, 2""")
def r4(t):
    return grid.resample(hourly_filled(t), S, "ts", "day", [
        r(F.avg("x"), 6).alias("mean_x"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.max_by("x", "pos").alias("last_x")])


@query("r4_downsample_keep_empty", f"""WITH {SQL_DAILY}, m AS (SELECT date_trunc('week', ts) AS w, count(*) AS n FROM daily GROUP BY 1),
e AS (SELECT min(w) AS a, max(w) AS b FROM m)
SELECT u.w AS ts, m.n FROM e, unnest(generate_series(a, b, INTERVAL 7 DAY)) AS u(w) LEFT JOIN m ON m.w = u.w""")
def r4e(t):
    rows = daily(t).withColumn("day", slot_start(F.col("pos"), "day"))
    return grid.resample(rows, [], "day", "week", [F.count("*").alias("n")], keep_empty=True)


@query("r5_future_range", f"""WITH {SQL_HOURLY} SELECT series, CAST(k AS INTEGER) AS step, max(ts) + CAST(k AS INTEGER) * INTERVAL 1 HOUR AS ts FROM hourly,
generate_series(1, 48) AS g(k) GROUP BY series, k""")
def r5(t):
    return grid.future_slots(hourly(t), S, "pos", 48).select("series", "step", slot_start(F.col("pos"), "hour").alias("ts"))


@query("r6_index_difference", """SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders
EXCEPT SELECT DISTINCT l_shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45""")
def r6(t):
    a = t.orders.select(F.col("o_orderdate").alias("ts")).distinct()
    b = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_shipdate").alias("ts"))
    return a.join(b, "ts", "left_anti")


@query("r7_index_hygiene", """WITH p AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, count(*) AS k FROM events GROUP BY 1, 2)
SELECT series, CAST(sum(k) AS BIGINT) AS n_rows, count(*) AS n_slots, CAST(sum(k - 1) AS BIGINT) AS n_duplicates,
CAST(date_diff('hour', min(ts), max(ts)) + 1 AS BIGINT) AS n_expected,
CAST(date_diff('hour', min(ts), max(ts)) + 1 - count(*) AS BIGINT) AS n_missing FROM p GROUP BY 1""")
def r7(t):
    rows = t.events.select(F.col("event_type").alias("series"), position(F.col("ts"), "hour").alias("pos"))
    return grid.hygiene(rows, S, "pos")


@query("r7_monotone_index", """SELECT count(*) AS n_rows, count(*) FILTER (ts < prev) AS n_backward FROM
(SELECT ts, lag(ts) OVER (ORDER BY event_id) AS prev FROM events)""")
def r7m(t):
    rows = look_around(t.events.select("event_id", "ts"), [], "event_id", {"prev": lag_of("ts", 1)})
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("ts") < F.col("prev")).alias("n_backward"))


# ------------------------------------------------------------------ scalar functions


@query("f1_calendar_parts", """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dow,
CAST(month(ts) AS INTEGER) AS month, CAST(year(ts) AS INTEGER) AS year, date_trunc('day', ts) AS day FROM events""")
def f1(t):
    ts = F.col("ts")
    return t.events.select("event_id", F.hour(ts).alias("hour"), F.weekday(ts).alias("dow"), F.month(ts).alias("month"),
                           F.year(ts).alias("year"), floor_to(ts, "day").alias("day"))


@query("f2_weekend_and_season", """SELECT o_orderkey, CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS is_weekend,
CASE (month(o_orderdate) % 12) // 3 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'fall' END AS season FROM orders""")
def f2(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", C.is_weekend(d).alias("is_weekend"), C.season(d).alias("season"))


_HOLIDAYS_SQL = ", ".join(f"DATE '{d}'" for d in sorted({d for d, _ in us_holidays(1980, 2040)}))


@query("j6_holiday_membership", f"""SELECT CAST(CAST(o_orderdate AS DATE) IN ({_HOLIDAYS_SQL}) AS INTEGER) AS is_holiday, count(*) AS n,
round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1""")
def j6(t):
    span = t.orders.agg(F.year(F.min("o_orderdate")).alias("a"), F.year(F.max("o_orderdate")).alias("b")).first()
    days = holiday_table(t.spark, span["a"] or 2000, span["b"] or 2000)
    rows = t.orders.withColumn("day", F.to_date("o_orderdate")).join(F.broadcast(days), "day", "left")
    return rows.groupBy(F.col("holiday").isNotNull().cast("int").alias("is_holiday")).agg(
        F.count("*").alias("n"), r(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("f3_cyclic_encodings", """SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hsin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hcos,
round(sin(2 * pi() * month(ts) / 12), 6) + 0.0 AS msin, round(cos(2 * pi() * month(ts) / 12), 6) + 0.0 AS mcos FROM events""")
def f3(t):
    hs, hc = C.cyclic(F.hour("ts"), 24)
    ms, mc = C.cyclic(F.month("ts"), 12)
    return t.events.select("event_id", r(hs).alias("hsin"), r(hc).alias("hcos"), r(ms).alias("msin"), r(mc).alias("mcos"))


_ORIGIN = 473352  # 2024-01-01 00:00 as hours since 1970


@query("f4_fourier_terms", f"""WITH {SQL_HOURLY} SELECT series, ts, round(sin(2 * pi() * (pos - {_ORIGIN}) / 24), 6) + 0.0 AS sin_24_1,
round(cos(2 * pi() * (pos - {_ORIGIN}) / 24), 6) + 0.0 AS cos_24_1, round(sin(4 * pi() * (pos - {_ORIGIN}) / 24), 6) + 0.0 AS sin_24_2,
round(cos(4 * pi() * (pos - {_ORIGIN}) / 24), 6) + 0.0 AS cos_24_2, round(sin(2 * pi() * (pos - {_ORIGIN}) / 168), 6) + 0.0 AS sin_168_1,
round(cos(2 * pi() * (pos - {_ORIGIN}) / 168), 6) + 0.0 AS cos_168_1 FROM hgrid""")
def f4(t):
    terms = C.fourier(F.col("pos"), _ORIGIN, [(24, 2), (168, 1)])
    return hourly_grid(t).select("series", "ts", *[r(c).alias(n) for n, c in terms.items()])


@query("f5_clean_names", "SELECT lower(trim(p_name)) AS name, count(*) AS n FROM part GROUP BY 1")
def f5(t):
    return t.part.groupBy(F.lower(F.trim("p_name")).alias("name")).agg(F.count("*").alias("n"))


@query("f6_half_even_rounding", """SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half_even, CAST(sign(l_quantity - 25) AS INTEGER) AS side,
round(pow(l_discount, 2), 8) AS sq FROM lineitem""")
def f6(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.rint(F.col("l_quantity") / 2).alias("half_even"),
                             F.signum(F.col("l_quantity") - 25).cast("int").alias("side"), r(F.pow("l_discount", F.lit(2)), 8).alias("sq"))
