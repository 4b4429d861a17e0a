"""Leak-safe supervised tables, splits and folds for series on grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import fourier, portable_hash
from tidewright.operators.ordering import attach, lag_of, look_around, rolling, sorted_scan


def supervised(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, ts: str | None = None, n_lags: int = 12,
               windows: Sequence[int] = (3, 6, 12)) -> DataFrame:
    """Lags 1 … n, rolling mean and std of the windows ending one slot back, month; warm-up rows dropped."""
    specs = {f"lag{k}": lag_of(value, k) for k in range(1, n_lags + 1)}
    for w in windows:
        specs[f"rmean{w}"], specs[f"rstd{w}"] = rolling("mean", value, w, 1), rolling("std", value, w, 1)
    rows = look_around(df, series_cols, pos, specs)
    if ts:
        rows = rows.withColumn("month", F.month(ts))
    return rows.na.drop(subset=[*specs, value])


def horizon_safe(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, horizon: int,
                 lags: Sequence[int], means: Sequence[tuple[str, int, int]] = ()) -> DataFrame:
    """Lags and rolling means that are known ``horizon`` slots ahead.

    ``means`` holds (name, width, offset). Every offset must be at least the horizon.
    """
    for k in [*lags, *[m[2] for m in means]]:
        if k < horizon:
            raise ValueError(f"offset {k} looks into the {horizon}-slot horizon")
    specs = {f"lag_{k}": lag_of(value, k) for k in sorted(set(lags))}
    specs |= {name: rolling("mean", value, width, offset) for name, width, offset in means}
    return look_around(df, series_cols, pos, specs)


def forecast_features(df: DataFrame, series_cols: Sequence[str], pos: str, ts: str, value: str, horizon: int, origin: int,
                      year: float = 8766, holidays: DataFrame | None = None) -> DataFrame:
    """The hourly feature set: safe lags, day and week means, calendar columns, annual harmonics.

    ``holidays`` (a column ``day``, a dozen rows a year) adds ``is_holiday``.
    """
    lags = [k for k in {horizon, horizon + 1, horizon + 2, horizon + 24, 168, 168 + horizon} if k >= horizon]
    rows = horizon_safe(df, series_cols, pos, value, horizon, lags, [("roll24", 24, horizon), ("roll168", 168, horizon)])
    if holidays is not None:
        named = holidays.select(F.col("day").alias("_day"), F.lit(1).alias("_off")).distinct()
        rows = rows.withColumn("_day", F.to_date(ts)).join(named, "_day", "left").withColumn("is_holiday", F.coalesce("_off", F.lit(0))).drop("_day", "_off")
    return rows.select("*", F.hour(ts).alias("hour"), F.weekday(ts).alias("dow"), F.month(ts).alias("month"),
                       *[c.alias(n) for n, c in fourier(F.col(pos), origin, [(year, 3)]).items()])


def split_last(df: DataFrame, series_cols: Sequence[str], pos: str, horizon: int) -> DataFrame:
    """``part``: test for the last ``horizon`` slots of each series, train before them."""
    ends = df.groupBy(*series_cols).agg((F.max(pos) - horizon).alias("_cut"))
    rows = attach(df, ends, series_cols)
    return rows.withColumn("part", F.when(F.col(pos) > F.col("_cut"), "test").otherwise("train")).drop("_cut")


def split_dates(df: DataFrame, ts: str, first_calibration: str, first_test: str) -> DataFrame:
    """``part`` by two dates: train, calibrate, test."""
    a, b = (F.lit(s).cast("timestamp_ntz") for s in (first_calibration, first_test))
    return df.withColumn("part", F.when(F.col(ts) < a, "train").when(F.col(ts) < b, "calibrate").otherwise("test"))


def folds(df: DataFrame, series_cols: Sequence[str], pos: str, n_splits: int, horizon: int, mode: str = "expanding",
          gap: int = 0) -> DataFrame:
    """Rows marked by (fold, role): test blocks tile the end of each series, training lies strictly before.

    ``sliding`` keeps the first fold's training width; ``gap`` leaves slots unused before each test block.
    """
    ends = df.groupBy(*series_cols).agg(F.min(pos).alias("_p0"), (F.max(pos) - F.min(pos) + 1).alias("_n"))
    rows = attach(df, ends, series_cols).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    i, start = F.col(pos) - F.col("_p0"), F.col("_n") - (n_splits - F.col("fold")) * horizon
    width = F.col("_n") - n_splits * horizon
    floor = F.lit(0) if mode == "expanding" else F.greatest(F.lit(0), start - width)
    role = F.when((i >= start) & (i < start + horizon), "test").when((i >= floor) & (i < start - gap), "train")
    return rows.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_p0", "_n")


def stratified(df: DataFrame, stratum: str, key: str, test_share: float | None = None, n_folds: int | None = None,
               seed: int = 0) -> DataFrame:
    """Rows placed by hash inside each stratum: ``is_test`` for the first share of them, or a ``fold`` number."""
    order = [portable_hash(F.col(key) + F.lit(seed)), F.col(key)]
    rows = sorted_scan(df, [stratum], order, row_number="_place", totals=True)
    if n_folds:
        rows = rows.withColumn("fold", ((F.col("_place") - 1) % n_folds).cast("int"))
    if test_share is not None:
        rows = rows.withColumn("is_test", F.col("_place") <= F.floor(F.col("_place_total") * test_share + 0.5))
    return rows.drop("_place", "_place_total")
