"""Queries: nearest neighbours, imputation and its grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import columns as C
from tidewright.operators import impute
from tidewright.operators.neighbours import hashed_nearest, nearest, recall
from tidewright.plans.panels import S, SQL_HOURLY, hourly_grid, r
from tidewright.plans.registry import query
from tidewright.session import settle


def _unnest(t):
    return t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


_NEAR = """WITH p AS (SELECT a.vec_id, a.label, b.vec_id AS near, b.label AS near_label, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, near) AS place FROM p)"""


@query("j9_nearest_neighbours", f"{_NEAR} SELECT vec_id, near AS vec_id_near, CAST(place AS INTEGER) AS place, round(d, 6) AS distance FROM k WHERE place <= 3")
def j9(t):
    rows = settle(_unnest(t))
    near = nearest(rows, rows, "vec_id", "vec_id", [f"e{i}" for i in range(64)], 3, exclude_same_id=True)
    return near.select("vec_id", "vec_id_near", "place", r("distance").alias("distance"))


_FEATURES = [f"e{i}" for i in range(64)]


def _hashed(t):
    rows = settle(_unnest(t))
    return rows, hashed_nearest(rows, rows, "vec_id", "vec_id", _FEATURES, 3, exclude_same_id=True, bucket=128)


@query("j9_hashed_neighbours")
def j9h(t):
    return _hashed(t)[1]


@query("j9_hashed_recall", """SELECT count(*) AS n_rows, CAST(3 * count(*) AS BIGINT) AS n_neighbours, true AS exact_distances, true AS recall_reached FROM embeddings""")
def j9r(t):
    rows, near = _hashed(t)
    near = settle(near)
    vectors = rows.select("vec_id", F.array(*_FEATURES).alias("x"))
    both = near.join(vectors, "vec_id").join(vectors.select(F.col("vec_id").alias("vec_id_near"), F.col("x").alias("y")), "vec_id_near")
    true = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    off = both.agg(F.max(F.abs(true - F.col("distance"))).alias("off")).select("off").scalar()
    reached = recall(near, rows, rows, "vec_id", "vec_id", _FEATURES, 3, exclude_same_id=True).select("recall").scalar()
    return near.agg(F.count_distinct("vec_id").alias("n_rows"), F.count("*").alias("n_neighbours")).select(
        "n_rows", "n_neighbours", (off < 1e-9).alias("exact_distances"), (reached >= 0.9).alias("recall_reached"))


@query("l36_nearest_label_accuracy", f"{_NEAR} SELECT count(*) AS n, round(avg((label = near_label)::INTEGER), 8) AS accuracy FROM k WHERE place = 1")
def l36(t):
    rows = settle(_unnest(t))
    near = nearest(rows, rows, "vec_id", "vec_id", [f"e{i}" for i in range(64)], 1, exclude_same_id=True)
    labels = rows.select(F.col("vec_id").alias("vec_id_near"), F.col("label").alias("near_label"))
    both = near.join(rows.select("vec_id", "label"), "vec_id").join(labels, "vec_id_near")
    return both.agg(F.count("*").alias("n"), r(F.avg((F.col("label") == F.col("near_label")).cast("int")), 8).alias("accuracy"))


@query("l36_duplicate_leak", """WITH d AS (SELECT text, lang, doc_id, (doc_id % 1000003) * 2654435761 % 1000003 % 4 = 0 AS test FROM documents),
g AS (SELECT text, lang, count(*) FILTER (test) AS in_test, count(*) FILTER (NOT test) AS in_train FROM d GROUP BY 1, 2)
SELECT CAST(sum(in_test) AS BIGINT) AS n_test, CAST(sum(in_test) FILTER (in_train > 0) AS BIGINT) AS leaked, count(*) FILTER (in_test > 0) AS n_distinct FROM g""")
def l36d(t):
    test = C.portable_hash(F.col("doc_id")) % 4 == 0
    g = t.documents.groupBy(F.sha2("text", 256), "lang").agg(F.count_if(test).alias("in_test"), F.count_if(~test).alias("in_train"))
    return g.agg(F.sum("in_test").alias("n_test"), F.sum(F.when(F.col("in_train") > 0, F.col("in_test"))).alias("leaked"),
                 F.count_if(F.col("in_test") > 0).alias("n_distinct"))


# One slot in five blocks of six hours is hidden by hash, on top of the real gaps.
_MASK = "((pos // 6) % 1000003) * 2654435761 % 1000003 % 5 = 0"
_MASKED = SQL_HOURLY + f""",
mk AS (SELECT series, ts, pos, y AS truth, CASE WHEN {_MASK} THEN NULL ELSE y END AS y, y IS NOT NULL AND {_MASK} AS hidden, isodow(ts) >= 6 AS we, hour(ts) AS h FROM hgrid)"""


def _masked(t):
    hidden = C.portable_hash(F.floor(F.col("pos") / 6)) % 5 == 0
    rows = hourly_grid(t).withColumn("truth", F.col("y")).withColumn("y", F.when(~hidden, F.col("y")))
    rows = rows.withColumn("hidden", F.col("truth").isNotNull() & hidden).withColumn("we", C.is_weekend(F.col("ts"))).withColumn("h", F.hour("ts"))
    return settle(rows.select("series", "pos", "ts", "truth", "y", "hidden", "we", "h"))


@query("i1_carry_fill", f"""WITH {_MASKED} SELECT series, ts, coalesce(last_value(y IGNORE NULLS) OVER w, first_value(y IGNORE NULLS) OVER v) AS filled FROM mk
WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def i1(t):
    return impute.carry_fill(_masked(t), S, "pos", "y", "filled").select("series", "ts", "filled")


_LINE = _MASKED + """,
ln AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS pp, last_value(y IGNORE NULLS) OVER w AS py,
first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER v AS np, first_value(y IGNORE NULLS) OVER v AS ny FROM mk
WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
li AS (SELECT *, CASE WHEN y IS NOT NULL THEN y WHEN pp IS NULL THEN ny WHEN np IS NULL THEN py ELSE py + (ny - py) * ((pos - pp) / (np - pp)) END AS line, coalesce(py, ny) AS carry FROM ln),
cl AS (SELECT series, we, h, avg(y) AS m FROM mk WHERE y IS NOT NULL GROUP BY 1, 2, 3)"""


@query("i2_line_fill", f"WITH {_LINE} SELECT series, ts, round(line, 6) AS filled FROM li")
def i2(t):
    return impute.line_fill(_masked(t), S, "pos", "y", "filled").select("series", "ts", r("filled").alias("filled"))


@query("i3_climatology_fill", f"WITH {_LINE} SELECT series, ts, round(coalesce(y, m), 6) AS filled FROM mk LEFT JOIN cl USING (series, we, h)")
def i3(t):
    return impute.climatology_fill(_masked(t), S, "y", ["we", "h"], "filled").select("series", "ts", r("filled").alias("filled"))


def _with_load(t):
    """Masked panel beside the pooled event count of the hour and the cycle columns."""
    from tidewright.functions.gridtime import position
    load = t.events.groupBy(position(F.col("ts"), "hour").alias("pos")).agg(F.count("*").cast("double").alias("load"))
    rows = _masked(t).join(load, "pos", "left").na.fill(0.0, ["load"])
    s, c = C.cyclic(F.col("h"), 24)
    return settle(rows.withColumn("hs", F.round(s * 10, 6)).withColumn("hc", F.round(c * 10, 6)))


_KNN = _MASKED + """,
ld AS (SELECT date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS load FROM events GROUP BY 1),
fx AS (SELECT mk.*, coalesce(load, 0) AS load, round(sin(2 * pi() * h / 24) * 10, 6) AS hs, round(cos(2 * pi() * h / 24) * 10, 6) AS hc FROM mk LEFT JOIN ld ON ld.ts = mk.ts),
pr AS (SELECT a.series, a.pos, b.y, row_number() OVER (PARTITION BY a.series, a.pos ORDER BY sqrt((a.load - b.load) * (a.load - b.load) + (a.hs - b.hs) * (a.hs - b.hs) + (a.hc - b.hc) * (a.hc - b.hc)), b.pos) AS place
       FROM fx a JOIN fx b ON a.series = b.series WHERE a.y IS NULL AND b.y IS NOT NULL),
kn AS (SELECT series, pos, avg(y) AS knn FROM pr WHERE place <= 8 GROUP BY 1, 2)"""


@query("i4_neighbour_fill", f"WITH {_KNN} SELECT fx.series, fx.ts, round(coalesce(fx.y, knn), 7) AS filled FROM fx LEFT JOIN kn ON kn.series = fx.series AND kn.pos = fx.pos")
def i4(t):
    return impute.neighbour_fill(_with_load(t), S, "pos", "y", ["load", "hs", "hc"], "filled").select("series", "ts", r("filled", 7).alias("filled"))


@query("i5_regression_fill")
def i5(t):
    rows = _with_load(t).select("series", "pos", "ts", "y", "load", "hs", "hc")
    return impute.regression_fill(rows, ["y"], ["load", "hs", "hc"]).select("series", "ts", "y")


@query("i6_hybrid_fill")
def i6(t):
    rows = _with_load(t)
    return impute.hybrid_fill(rows, S, "pos", "y", ["load", "hs", "hc"], "filled", short_max=6).select("series", "ts", "filled")


@query("i7_injected_gaps")
def i7(t):
    marked, _ = impute.inject_gaps(hourly_grid(t).select("series", "pos", "y"), S, "pos", "y", 150, seed=1)
    return marked.groupBy("series").agg(F.count_if("masked").alias("n_masked"), F.max("gap_len").alias("longest"))


@query("i7_injection_report")
def i7r(t):
    return impute.inject_gaps(hourly_grid(t).select("series", "pos", "y"), S, "pos", "y", 150, seed=1)[1]


def _filled_three(t):
    rows = _masked(t)
    a = impute.carry_fill(rows, S, "pos", "y", "carry")
    b = impute.line_fill(a, S, "pos", "y", "line")
    return settle(impute.climatology_fill(b, S, "y", ["we", "h"], "climatology"))


@query("i8_fill_scores", f"""WITH {_LINE}, al AS (SELECT truth, carry, line, coalesce(y, m) AS climatology FROM li LEFT JOIN cl USING (series, we, h) WHERE hidden),
lg AS (SELECT truth, 'carry' AS method, carry AS f FROM al UNION ALL SELECT truth, 'line', line FROM al UNION ALL SELECT truth, 'climatology', climatology FROM al)
SELECT method, count(f - truth) AS n, round(avg(abs(f - truth)), 6) AS mae, round(sqrt(avg(pow(f - truth, 2))), 6) AS rmse, round(stddev_pop(f), 6) AS fill_sd, round(stddev_pop(truth), 6) AS true_sd FROM lg GROUP BY 1""")
def i8(t):
    s = impute.score_fills(_filled_three(t).filter("hidden"), "truth", ["carry", "line", "climatology"])
    return s.select("method", "n", *[r(c).alias(c) for c in ("mae", "rmse", "fill_sd", "true_sd")])


@query("i8_scores_by_gap_length", f"""WITH {_LINE}, gp AS (SELECT series, pos, pos - row_number() OVER (PARTITION BY series ORDER BY pos) AS g FROM mk WHERE y IS NULL),
gl AS (SELECT series, pos, count(*) OVER (PARTITION BY series, g) AS k FROM gp), al AS (SELECT truth, line, carry, k FROM li JOIN gl USING (series, pos) WHERE hidden),
lg AS (SELECT k, truth, 'carry' AS method, carry AS f FROM al UNION ALL SELECT k, truth, 'line', line FROM al)
SELECT CASE WHEN k <= 3 THEN '1-3h' WHEN k <= 12 THEN '4-12h' WHEN k <= 48 THEN '13-48h' ELSE '49h+' END AS band, method, count(*) AS n, round(avg(abs(f - truth)), 6) AS mae FROM lg GROUP BY 1, 2""")
def i8b(t):
    from tidewright.operators.grid import mark_runs
    rows = settle(mark_runs(_filled_three(t), S, "pos", F.col("y").isNull())).filter("hidden")
    s = impute.score_fills(rows, "truth", ["carry", "line"], impute.gap_band("run_length"))
    return s.select("band", "method", "n", r("mae").alias("mae"))
