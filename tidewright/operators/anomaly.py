"""Anomalies against a calendar norm, deseasonalised series and change points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.ordering import attach, running
from tidewright.session import settle


def residual_scores(df: DataFrame, series_cols: Sequence[str], value: str, calendar: Sequence[str],
                    max_cells: int = 12 * 2 * 24) -> DataFrame:
    """Residual from the mean of each calendar cell, and the residual in standard deviations."""
    keys = [*series_cols, *calendar]
    bound = max_cells if not series_cols else None
    rows = attach(df, df.groupBy(*keys).agg(F.avg(value).alias("_m")), keys, max_rows=bound)
    rows = rows.withColumn("resid", F.col(value) - F.col("_m")).drop("_m")
    return attach(rows, rows.groupBy(*series_cols).agg(F.stddev_samp("resid").alias("_sd")), series_cols).withColumn(
        "z", F.col("resid") / F.col("_sd")).drop("_sd")


def extremes(df: DataFrame, score: str, k: int, tiebreak: Sequence[str]) -> DataFrame:
    """The k largest and k smallest scores, marked by side."""
    high = df.orderBy(F.desc(score), *tiebreak).limit(k).withColumn("side", F.lit("high"))
    low = df.orderBy(F.asc(score), *tiebreak).limit(k).withColumn("side", F.lit("low"))
    return high.unionByName(low)


def deseasonalise(df: DataFrame, series_cols: Sequence[str], value: str, cell: Column, out: str) -> DataFrame:
    """Value minus the mean of its calendar cell."""
    rows = df.withColumn("_cell", cell)
    means = rows.groupBy(*series_cols, "_cell").agg(F.avg(value).alias("_m"))
    return attach(rows, means, [*series_cols, "_cell"]).withColumn(out, F.col(value) - F.col("_m")).drop("_cell", "_m")


def change_points(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, n_breaks: int, min_size: int,
                  penalty: float | None = None) -> DataFrame:
    """Binary segmentation of the mean: (series, round, break_pos, gain).

    One running total serves every round. A round scores all splits of all segments in one aggregate and
    keeps the best of each series; ``penalty`` stops a series whose best gain falls below it.
    ``break_pos`` is the first slot of the right-hand segment.
    """
    keys = list(series_cols)
    rows = running(df.select(*keys, pos, value), keys, pos, sums={"_cum": value, "_i": F.lit(1).cast("long")})
    rows = settle(rows.select(*keys, pos, value, "_cum", "_i"))
    found = None
    for number in range(1, n_breaks + 1):
        if found is None:
            marked = rows.withColumn("_seg", F.lit(0))
        else:
            cuts = found.groupBy(*keys).agg(F.collect_list("break_pos").alias("_cuts"))  # at most n_breaks a series
            marked = attach(rows, cuts, keys, how="left") if keys else attach(rows, cuts)
            marked = marked.withColumn("_seg", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(pos))), F.lit(0))).drop("_cuts")
        segs = marked.groupBy(*keys, "_seg").agg(
            F.sum(value).alias("_total"), F.count("*").alias("_m"), F.min("_i").alias("_i0"),
            F.min_by(F.col("_cum") - F.col(value), "_i").alias("_c0"))
        scored = marked.join(segs, [*keys, "_seg"])
        left_n, left = F.col("_i") - F.col("_i0") + 1, F.col("_cum") - F.col("_c0")
        right_n, right = F.col("_m") - left_n, F.col("_total") - left
        gain = left * left / left_n + right * right / right_n - F.col("_total") ** 2 / F.col("_m")
        scored = scored.filter((left_n >= min_size) & (right_n >= min_size)).withColumn("_gain", gain)
        best = scored.groupBy(*keys).agg(F.max_by(F.struct((F.col(pos) + 1).alias("break_pos"), F.col("_gain").alias("gain")),
                                                  F.struct(F.col("_gain"), -F.col(pos))).alias("b")).select(*keys, "b.*")
        if not keys:
            best = best.filter(F.col("break_pos").isNotNull())
        best = best.withColumn("round", F.lit(number))
        if penalty is not None:
            best = best.filter(F.col("gain") > penalty)
            if found is not None:
                going = found.filter(F.col("round") == number - 1).select(*keys).distinct()
                best = best.join(going, keys, "left_semi") if keys else best
        best = settle(best)
        found = best if found is None else found.unionByName(best)
        found = settle(found)
    return found


def segment_means(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, breaks: DataFrame) -> DataFrame:
    """Mean and bounds of each segment between breaks."""
    keys = list(series_cols)
    cuts = breaks.groupBy(*keys).agg(F.collect_list("break_pos").alias("_cuts"))
    rows = attach(df, cuts, keys, how="left") if keys else attach(df, cuts)
    rows = rows.withColumn("segment", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(pos))), F.lit(0)))
    return rows.groupBy(*keys, "segment").agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.avg(value).alias("mean"))
