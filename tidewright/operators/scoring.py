"""Forecast baselines, accuracy metrics and interval scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.grid import future_slots
from tidewright.operators.ordering import attach, lag_of, look_around, quantiles, running


# ------------------------------------------------------------------ baselines
def baselines(train: DataFrame, series_cols: Sequence[str], pos: str, value: str, horizon: int, m: int) -> DataFrame:
    """Naive, seasonal naive, drift and mean forecasts: (series, step, pos, model, yhat)."""
    keys = list(series_cols)
    ends = train.groupBy(*keys).agg(F.min_by(value, pos).alias("_first"), F.max_by(value, pos).alias("_last"), F.avg(value).alias("_mean"),
                                    F.count("*").alias("_n"), F.max(pos).alias("_end"))
    steps = attach(future_slots(train, keys, pos, horizon), ends, keys)
    season = attach(train, ends.select(*keys, "_end"), keys).filter(F.col(pos) > F.col("_end") - m).select(
        *keys, (F.col(pos) - F.col("_end") + m - 1).alias("_k"), F.col(value).alias("_season"))
    steps = steps.withColumn("_k", ((F.col("step") - 1) % m).cast("bigint")).join(season, [*keys, "_k"], "left")
    slope = (F.col("_last") - F.col("_first")) / F.nullif(F.col("_n") - 1, F.lit(0))
    models = {"naive": F.col("_last"), "seasonal_naive": F.col("_season"), "drift": F.col("_last") + slope * F.col("step"), "mean": F.col("_mean")}
    return steps.select(*keys, "step", pos, F.inline(F.array(*[F.struct(F.lit(n).alias("model"), c.alias("yhat")) for n, c in models.items()])))


def climatology_forecast(train: DataFrame, future: DataFrame, series_cols: Sequence[str], value: str, calendar: Sequence[str]) -> DataFrame:
    """Forecast each future row by the training mean of its calendar cell."""
    keys = [*series_cols, *calendar]
    return attach(future, train.groupBy(*keys).agg(F.avg(value).alias("yhat")), keys, how="left")


def one_step_walk(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, m: int, initial: int) -> DataFrame:
    """One-step walk-forward of the four baselines in one plan: each forecast sees only earlier slots."""
    keys = list(series_cols)
    rows = running(df.select(*keys, pos, value), keys, pos, sums={"_sum": value, "_i": F.lit(1).cast("long")})
    rows = look_around(rows, keys, pos, {"_last": lag_of(value, 1), "_season": lag_of(value, m)})
    first = df.groupBy(*keys).agg(F.min_by(value, pos).alias("_first"))
    rows = attach(rows, first, keys).filter(F.col("_i") > initial)
    seen = F.col("_i") - 1
    models = {"naive": F.col("_last"), "seasonal_naive": F.col("_season"), "mean": (F.col("_sum") - F.col(value)) / seen,
              "drift": F.col("_last") + (F.col("_last") - F.col("_first")) / F.nullif(seen - 1, F.lit(0))}
    return rows.select(*keys, pos, F.col(value).alias("y"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), c.alias("yhat")) for n, c in models.items()]))).filter(F.col("yhat").isNotNull())


# ------------------------------------------------------------------ accuracy
def naive_scale(train: DataFrame, series_cols: Sequence[str], pos: str, value: str, m: int) -> DataFrame:
    """In-sample mean absolute change over ``m`` slots, the divisor of MASE."""
    rows = look_around(train.select(*series_cols, pos, value), series_cols, pos, {"_l": lag_of(value, m)})
    return rows.groupBy(*series_cols).agg(F.avg(F.abs(F.col(value) - F.col("_l"))).alias("scale"))


def accuracy(df: DataFrame, keys: Sequence[str], y: str, yhat: str, scale: DataFrame | None = None,
             scale_keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE, sMAPE, WAPE (per cent) and, with a scale table, MASE."""
    e, a = F.abs(F.col(y) - F.col(yhat)), F.abs(F.col(y))
    rows = df if scale is None else attach(df, scale, scale_keys)
    mase = [] if scale is None else [(F.avg(e) / F.nullif(F.max("scale"), F.lit(0.0))).alias("mase")]
    return rows.groupBy(*keys).agg(
        F.count(e).alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(e / F.nullif(a, F.lit(0.0)))).alias("mape"),
        (100 * F.avg(2 * e / F.nullif(a + F.abs(F.col(yhat)), F.lit(0.0)))).alias("smape"),
        (100 * F.sum(e) / F.nullif(F.sum(F.when(F.col(yhat).isNotNull(), a)), F.lit(0.0))).alias("wape"), *mase)


def leaderboard(df: DataFrame, y: str, yhat: str, scale: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    """Accuracy per series and model, best MASE first."""
    return accuracy(df, [*series_cols, "model"], y, yhat, scale, series_cols).orderBy(*series_cols, "mase", "model")


# ------------------------------------------------------------------ intervals
def conformal_radius(calibration: DataFrame, keys: Sequence[str], y: str, yhat: str, alpha: float = 0.1,
                     finite_sample: bool = True) -> DataFrame:
    """Radius of the split-conformal interval, from absolute calibration errors.

    The finite-sample order statistic ceil((n + 1)(1 - alpha)) keeps the guarantee; the plain interpolated
    quantile is the other choice.
    """
    rows = calibration.select(*keys, F.abs(F.col(y) - F.col(yhat)).alias("_e"))
    if finite_sample:
        return quantiles(rows, keys, "_e", {}, finite_sample={"radius": 1 - alpha})
    return quantiles(rows, keys, "_e", {"radius": 1 - alpha})


def cqr_offset(calibration: DataFrame, keys: Sequence[str], y: str, lo: str, hi: str, alpha: float = 0.1,
               finite_sample: bool = True) -> DataFrame:
    """How far to widen a quantile interval so that it covers 1 - alpha of calibration rows."""
    rows = calibration.select(*keys, F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi)).alias("_e"))
    if finite_sample:
        return quantiles(rows, keys, "_e", {}, finite_sample={"offset": 1 - alpha})
    return quantiles(rows, keys, "_e", {"offset": 1 - alpha})


def coverage(df: DataFrame, keys: Sequence[str], y: str, lo: str | Column, hi: str | Column) -> DataFrame:
    """Share of rows inside the interval and its mean width."""
    lo, hi = (F.col(c) if isinstance(c, str) else c for c in (lo, hi))
    inside = F.col(y).between(lo, hi).cast("double")
    return df.groupBy(*keys).agg(F.count(inside).alias("n"), F.avg(inside).alias("coverage"), F.avg(hi - lo).alias("width"))


def pinball(y: str, q: str, level: float) -> Column:
    e = F.col(y) - F.col(q)
    return F.avg(F.greatest(level * e, (level - 1) * e))


def quantile_reliability(df: DataFrame, keys: Sequence[str], y: str, level_cols: Mapping[float, str]) -> DataFrame:
    """Observed share at or below each predicted quantile, with its pinball loss: (level, observed, pinball)."""
    one = df.groupBy(*keys).agg(*[F.avg((F.col(y) <= F.col(c)).cast("double")).alias(f"_o{i}") for i, c in enumerate(level_cols.values())],
                                *[pinball(y, c, q).alias(f"_p{i}") for i, (q, c) in enumerate(level_cols.items())])
    return one.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(float(q)).alias("level"), F.col(f"_o{i}").alias("observed"), F.col(f"_p{i}").alias("pinball"))
        for i, q in enumerate(level_cols)])))


def tail_bias(df: DataFrame, keys: Sequence[str], y: str, yhat: str, thresholds: Sequence[float]) -> DataFrame:
    """Mean actual and predicted value over rows above each threshold."""
    aggs = []
    for i, th in enumerate(thresholds):
        over = F.col(y) > th
        aggs += [F.count_if(over).alias(f"_n{i}"), F.avg(F.when(over, F.col(y))).alias(f"_a{i}"), F.avg(F.when(over, F.col(yhat))).alias(f"_p{i}")]
    one = df.groupBy(*keys).agg(*aggs)
    return one.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(float(th)).alias("threshold"), F.col(f"_n{i}").alias("n"), F.col(f"_a{i}").alias("mean_actual"), F.col(f"_p{i}").alias("mean_predicted"))
        for i, th in enumerate(thresholds)])))


def exceedance(df: DataFrame, keys: Sequence[str], y: str, yhat: str, threshold: float) -> DataFrame:
    """Warning quality at a threshold: confusion counts, precision, recall, F1."""
    a, p = F.col(y) > threshold, F.col(yhat) > threshold
    one = df.groupBy(*keys).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return one.select("*", (tp / F.nullif(tp + fp, F.lit(0))).alias("precision"), (tp / F.nullif(tp + fn, F.lit(0))).alias("recall"),
                      (2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"))
