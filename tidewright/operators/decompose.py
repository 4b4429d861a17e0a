"""Trend, seasonal and remainder parts of a series on a complete grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.ordering import attach, centred, look_around, quantiles
from tidewright.session import settle


def _trend(df: DataFrame, series_cols, pos, value, period: int, out: str) -> DataFrame:
    half = period // 2
    if period % 2:
        return look_around(df, series_cols, pos, {out: centred("mean", value, half, half)})
    rows = look_around(df, series_cols, pos, {"_a": centred("mean", value, half, half - 1), "_b": centred("mean", value, half - 1, half)})
    return rows.withColumn(out, (F.col("_a") + F.col("_b")) / 2).drop("_a", "_b")


def _seasonal(df: DataFrame, series_cols, pos, detrended: str, period: int, out: str, robust: bool) -> DataFrame:
    """Mean (or median) of each phase, shifted to average zero over one period."""
    keys = [*series_cols, "_phase"]
    rows = settle(df.withColumn("_phase", F.pmod(F.col(pos), F.lit(period))))
    if robust:
        by_phase = quantiles(rows, keys, detrended, {"_s": 0.5})
    else:
        by_phase = rows.groupBy(*keys).agg(F.avg(detrended).alias("_s"))
    level = by_phase.groupBy(*series_cols).agg(F.avg("_s").alias("_level"))
    table = attach(by_phase, level, series_cols).select(*keys, (F.col("_s") - F.col("_level")).alias(out))
    return attach(rows, table, keys, how="left").drop("_phase")


def classical(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, period: int, robust: bool = False) -> DataFrame:
    """Additive decomposition: centred moving average, phase means, remainder.

    ``robust`` takes phase medians, so single bad values do not bend the seasonal shape.
    """
    rows = _trend(df, series_cols, pos, value, period, "trend").withColumn("_d", F.col(value) - F.col("trend"))
    rows = _seasonal(rows, series_cols, pos, "_d", period, "seasonal", robust).drop("_d")
    return rows.withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal"))


def multi_seasonal(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, periods: Sequence[int],
                   robust: bool = False) -> DataFrame:
    """Several seasonal parts, shortest period first: each is taken from what the shorter ones leave."""
    rows = df.withColumn("_left", F.col(value))
    for p in sorted(periods):
        rows = _trend(rows, series_cols, pos, "_left", p, "trend").withColumn("_d", F.col("_left") - F.col("trend"))
        rows = _seasonal(rows, series_cols, pos, "_d", p, f"seasonal_{p}", robust)
        rows = rows.withColumn("_left", F.col("_left") - F.col(f"seasonal_{p}")).drop("_d", "trend")
    longest = max(periods)
    rows = _trend(rows, series_cols, pos, "_left", longest, "trend")
    return rows.withColumn("resid", F.col("_left") - F.col("trend")).drop("_left")


def strengths(parts: DataFrame, series_cols: Sequence[str], seasonal: Sequence[str]) -> DataFrame:
    """Strength of trend and of each seasonal part in [0, 1], and the swing of each."""
    rows = parts.filter(F.col("resid").isNotNull() & F.col("trend").isNotNull())

    def strength(c):
        return F.greatest(F.lit(0.0), 1 - F.var_samp("resid") / F.var_samp(F.col(c) + F.col("resid")))

    return rows.groupBy(*series_cols).agg(
        strength("trend").alias("trend_strength"), (F.max("trend") - F.min("trend")).alias("trend_swing"),
        *[strength(c).alias(f"{c}_strength") for c in seasonal],
        *[(F.max(c) - F.min(c)).alias(f"{c}_swing") for c in seasonal])
