"""Input-error scenarios: autocorrelated noise, fans of forecasts, variance split."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import clip, hash_normal
from tidewright.operators.ordering import attach
from tidewright.operators.recursion import affine_filter


def scenarios(df: DataFrame, series_cols: Sequence[str], pos: str, sd: Mapping[str, float], n_scenarios: int,
              phi: float = 0.8, seed: int = 0) -> DataFrame:
    """Rows × scenarios with the columns of ``sd`` moved by AR(1) noise of that stationary deviation.

    Shocks are hashes of (series, scenario, slot), so the draw is the same for any partitioning; the noise
    starts at zero and moved columns stay non-negative.
    """
    keys = [*series_cols, "scenario"]
    rows = df.withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(n_scenarios - 1))))
    rows = attach(rows, df.groupBy(*series_cols).agg(F.min(pos).alias("_p0")), series_cols)
    shock = (1 - phi * phi) ** 0.5
    for i, (c, s) in enumerate(sd.items()):
        draw = hash_normal(*[F.col(k) for k in keys], F.col(pos), seed=seed * 101 + i) * (s * shock)
        rows = rows.withColumn(f"_e_{c}", F.when(F.col(pos) == F.col("_p0"), 0.0).otherwise(draw))
    moved = affine_filter(rows, keys, pos, {f"_x_{c}": f"_e_{c}" for c in sd}, phi)
    for c in sd:
        moved = moved.withColumn(c, clip(F.col(c) + F.col(f"_x_{c}"), lo=0.0))
    return moved.drop("_p0", *[f"_e_{c}" for c in sd], *[f"_x_{c}" for c in sd])


def fan(rows: DataFrame, predict: Callable[[DataFrame], DataFrame], series_cols: Sequence[str], pos: str, prediction: str,
        levels: Mapping[str, float]) -> DataFrame:
    """Percentiles over scenarios at each slot; ``predict`` scores all scenario rows at once."""
    scored = predict(rows).withColumn(prediction, clip(F.col(prediction), lo=0.0))
    return scored.groupBy(*series_cols, pos).agg(  # a group holds one row per scenario
        F.count("*").alias("n_scenarios"), F.stddev_pop(prediction).alias("spread"),
        *[F.percentile(prediction, F.lit(float(q))).alias(n) for n, q in levels.items()])


def variance_split(df: DataFrame, keys: Sequence[str], model_error: Column, input_error: Column) -> DataFrame:
    """Variance of the forecast error from the model and from its inputs."""
    return df.groupBy(*keys).agg(F.var_samp(model_error).alias("model_var"), F.var_samp(input_error).alias("input_var"))


def stacked_interval(df: DataFrame, centre: str, z: float) -> DataFrame:
    """Interval from both variance parts."""
    half = z * F.sqrt(F.col("model_var") + F.col("input_var"))
    return df.withColumn("lo", F.col(centre) - half).withColumn("hi", F.col(centre) + half)
