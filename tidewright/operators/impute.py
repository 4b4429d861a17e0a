"""Filling gaps, and grading the fills on values that were hidden on purpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import bins, clip, hash_unit
from tidewright.operators.grid import fill, interpolate, mark_runs, run_table
from tidewright.operators.neighbours import nearest
from tidewright.operators.ordering import attach, sorted_scan
from tidewright.session import settle


def carry_fill(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, out: str) -> DataFrame:
    """Last value forward, then first value backward over a leading gap."""
    return fill(df, series_cols, pos, value, out, "both")


def line_fill(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, out: str) -> DataFrame:
    """Straight line between known values, edges filled."""
    return interpolate(df, series_cols, pos, value, out, fill_leading=True)


def climatology_fill(df: DataFrame, series_cols: Sequence[str], value: str, calendar: Sequence[str], out: str) -> DataFrame:
    """Mean of the calendar cell, fitted only on the rows whose value is present."""
    keys = [*series_cols, *calendar]
    table = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("_m"))
    return attach(df, table, keys, how="left").withColumn(out, F.coalesce(value, "_m")).drop("_m")


def neighbour_fill(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, features: Sequence[str], out: str,
                   k: int = 8) -> DataFrame:
    """Mean value of the k most similar observed rows, by distance over ``features``."""
    rows = settle(df)
    near = nearest(rows.filter(F.col(value).isNull()), rows.filter(F.col(value).isNotNull()), pos, pos, features, k, series_cols)
    values = rows.select(*series_cols, F.col(pos).alias(f"{pos}_near"), F.col(value).alias("_v"))
    means = near.join(values, [*series_cols, f"{pos}_near"]).groupBy(*series_cols, pos).agg(F.avg("_v").alias("_knn"))
    return rows.join(means, [*series_cols, pos], "left").withColumn(out, F.coalesce(value, "_knn")).drop("_knn")


def regression_fill(df: DataFrame, targets: Sequence[str], covariates: Sequence[str], max_rounds: int = 10,
                    tol: float = 1e-3, ridge: float = 1e-6) -> DataFrame:
    """Chained regressions: each gappy column on all others, repeated until the filled values settle."""
    rows = df
    for c in targets:
        rows = rows.withColumn(f"_gap_{c}", F.col(c).isNull())
    rows = attach(rows, df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in targets]))
    rows = rows.select(*[c for c in df.columns if c not in targets], *[f"_gap_{c}" for c in targets],
                       *[F.coalesce(c, f"_mean_{c}").cast("double").alias(c) for c in targets])
    rounds = 1 if len(targets) == 1 else max_rounds
    for _ in range(rounds):
        rows = settle(rows)
        moved = []
        for c in targets:
            others = [x for x in (*targets, *covariates) if x != c]
            table = VectorAssembler(inputCols=others, outputCol="_x").transform(rows)
            model = LinearRegression(featuresCol="_x", labelCol=c, predictionCol="_p", regParam=ridge).fit(table.filter(~F.col(f"_gap_{c}")))
            table = model.transform(table).withColumn("_new", F.when(F.col(f"_gap_{c}"), F.col("_p")).otherwise(F.col(c)))
            rows = table.withColumn(f"_step_{c}", F.abs(F.col("_new") - F.col(c))).withColumn(c, F.col("_new")).drop("_x", "_p", "_new")
            moved.append(f"_step_{c}")
        rows = settle(rows)
        change = rows.agg(*[F.max(m) for m in moved]).first()
        scale = rows.agg(*[F.max(F.abs(c)) for c in targets]).first()
        rows = rows.drop(*moved)
        if all((d or 0.0) <= tol * (s or 1.0) for d, s in zip(change, scale, strict=True)):
            break
    return rows.select(*df.columns)


def hybrid_fill(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, covariates: Sequence[str], out: str,
                short_max: int = 48) -> DataFrame:
    """Line for gaps up to ``short_max`` slots, regression for longer ones, never below zero."""
    rows = settle(mark_runs(df, series_cols, pos, F.col(value).isNull()))
    line = line_fill(rows, series_cols, pos, value, "_line")
    filled = regression_fill(rows.select(*series_cols, pos, value, *covariates), [value], covariates)
    both = line.join(filled.select(*series_cols, pos, F.col(value).alias("_reg")), [*series_cols, pos])
    long_gap = F.col(value).isNull() & (F.col("run_length") > short_max)
    return both.withColumn(out, clip(F.when(long_gap, F.col("_reg")).otherwise(F.col("_line")), lo=0.0)).drop(
        "_line", "_reg", "run_start", "run_end", "run_length")


def inject_gaps(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, n_gaps: int, seed: int = 0,
                spare: int = 4) -> tuple[DataFrame, DataFrame]:
    """Hide observed values in gaps whose lengths are drawn from the real ones of all series.

    Returns the rows with ``masked`` and ``gap_len``, and a report of asked and placed gaps, with every series in it.
    Candidates are drawn by hash, ``spare`` for each gap asked for in place of retries. In the order of their numbers one is kept when all its
    slots are observed and no kept one touches them: each round keeps those that come first at all their slots and drops what they touch.
    """
    keys = list(series_cols)
    rows = settle(df)
    runs = run_table(rows.select(*keys, pos, value), keys, pos, F.col(value).isNull())
    runs = settle(sorted_scan(runs, [], [*map(F.col, keys), F.col("run_start")], row_number="_i").select("_i", F.col("run_length").alias("_len")))
    n_runs = runs.count()
    ends = rows.groupBy(*keys).agg(F.min(pos).alias("_p0"), (F.max(pos) - F.min(pos) + 1).alias("_n"))
    cand = ends.withColumn("_id", F.explode(F.sequence(F.lit(1), F.lit(n_gaps * spare))))
    cand = cand.withColumn("_i", (F.floor(hash_unit(*keys, F.col("_id"), seed=2 * seed + 11) * F.lit(n_runs)) + 1).cast("bigint"))
    cand = cand.join(runs, "_i").filter(F.col("_len") < F.col("_n"))
    begin = F.col("_p0") + F.floor(hash_unit(*keys, F.col("_id"), seed=2 * seed + 12) * (F.col("_n") - F.col("_len")))
    slots = cand.withColumn("_b", begin.cast("bigint")).withColumn(pos, F.explode(F.sequence("_b", F.col("_b") + F.col("_len") - 1)))
    slots = settle(slots.select(*keys, "_id", "_len", pos).join(rows.filter(F.col(value).isNotNull()).select(*keys, pos), [*keys, pos]))
    whole = slots.groupBy(*keys, "_id", "_len").agg(F.count("*").alias("_k")).filter("_k = _len").select(*keys, "_id")
    slots = settle(slots.join(whole, [*keys, "_id"], "left_semi"))
    left, kept = slots, slots.select(*keys, "_id").limit(0)
    while not left.isEmpty():
        owner = left.groupBy(*keys, pos).agg(F.min("_id").alias("_owner"))
        first = left.join(owner, [*keys, pos]).filter("_owner = _id").groupBy(*keys, "_id", "_len").agg(F.count("*").alias("_k"))
        first = settle(first.filter("_k = _len").select(*keys, "_id"))
        kept = kept.unionByName(first)
        taken = left.join(first, [*keys, "_id"], "left_semi").select(*keys, pos)
        hit = left.join(taken, [*keys, pos], "left_semi").select(*keys, "_id").distinct()
        left = settle(left.join(hit, [*keys, "_id"], "left_anti"))
    ranked = sorted_scan(kept, keys, [F.col("_id")], row_number="_place", bounded=True).filter(F.col("_place") <= n_gaps)
    kept = settle(ranked.select(*keys, "_id"))
    mask = slots.join(kept, [*keys, "_id"]).select(*keys, pos, F.col("_len").alias("gap_len"))
    marked = rows.join(mask, [*keys, pos], "left").withColumn("masked", F.col("gap_len").isNotNull())
    report = ends.select(*keys).join(kept.groupBy(*keys).agg(F.count("*").alias("placed")), keys, "left").select(
        *keys, F.coalesce("placed", F.lit(0)).alias("placed"), F.lit(n_gaps).alias("asked"))
    return marked, report


# Gap-length bands of the score table.
GAP_EDGES = (0, 3, 12, 48, float("inf"))
GAP_BANDS = ("1-3h", "4-12h", "13-48h", "49h+")


def score_fills(df: DataFrame, truth: str, fills: Sequence[str], band: Column | None = None) -> DataFrame:
    """MAE, RMSE and preserved spread of each fill over hidden rows, optionally by band."""
    rows = df if band is None else df.withColumn("band", band)
    keys = [] if band is None else ["band"]
    long = rows.select(*keys, F.col(truth).alias("truth"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("method"), F.col(c).alias("fill")) for c in fills])))
    e = F.col("fill") - F.col("truth")
    return long.groupBy(*keys, "method").agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                                             F.stddev_pop("fill").alias("fill_sd"), F.stddev_pop("truth").alias("true_sd"))


def gap_band(length: str) -> Column:
    return bins(F.col(length), GAP_EDGES, GAP_BANDS)
