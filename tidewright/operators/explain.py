"""Model explanation: importances, partial dependence and additive attribution, each in one scoring pass."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.ordering import sorted_scan
from tidewright.session import settle


def gain_importance(model, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Impurity gain shares of a fitted tree model (one value per feature)."""
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def permutation_importance(df: DataFrame, key: str, features: Sequence[str], predict: Callable[[DataFrame], DataFrame],
                           loss: Column, seed: int = 0, n_repeats: int = 1) -> DataFrame:
    """Rise of the mean loss when one column is shuffled, as a mean over ``n_repeats`` shuffles: (feature, base_loss, loss, rise).

    The shuffle pairs the row at each place in key order with the row at the same place in hash order, so
    no task sees all rows. ``predict`` adds ``yhat``; ``loss`` is a column over its result.
    """
    rows = settle(df)
    here = sorted_scan(rows, [], [F.col(key)], row_number="_place")
    other = None
    for i in range(n_repeats):
        there = sorted_scan(rows.select(key, *features), [], [F.xxhash64(key, F.lit(seed + i)), F.col(key)], row_number="_place")
        there = there.select("_place", F.lit(i).alias("_repeat"), *[F.col(f).alias(f"_o_{f}") for f in features])
        other = there if other is None else other.unionByName(there)
    names = [F.lit(f) for f in features]
    both = here.join(other, "_place").withColumn("_shuffled", F.explode(F.when(F.col("_repeat") == 0, F.array(F.lit("-"), *names)).otherwise(F.array(*names))))
    moved = both.select(*[c for c in rows.columns if c not in features], "_shuffled",
                        *[F.when(F.col("_shuffled") == f, F.col(f"_o_{f}")).otherwise(F.col(f)).alias(f) for f in features])
    scores = settle(predict(moved).groupBy("_shuffled").agg(F.avg(loss).alias("loss")))
    base = scores.filter("_shuffled = '-'").select("loss").scalar()
    out = scores.filter("_shuffled <> '-'").select(F.col("_shuffled").alias("feature"), base.alias("base_loss"), "loss")
    return out.withColumn("rise", F.col("loss") - F.col("base_loss"))


def partial_dependence(df: DataFrame, grid: Mapping[str, Sequence[float]], predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Mean prediction with one or two columns fixed at each grid point, over all rows."""
    rows = df
    for name, points in grid.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(float(p)) for p in points])))
    return predict(rows).groupBy(*grid).agg(F.avg("yhat").alias("mean_prediction"), F.stddev_samp("yhat").alias("spread"))


def sampled_shapley(df: DataFrame, key: str, features: Sequence[str], predict: Callable[[DataFrame], DataFrame], n_permutations: int = 8,
                    seed: int = 0) -> DataFrame:
    """Additive attribution of every row: (key, feature, value, attribution, yhat, base).

    Each permutation adds the row's features one by one to a background row of its own, drawn by hash; with as many permutations as there are
    orders of the features, every order is taken. All rows, permutations and
    stages are scored in one pass; attributions of a row add up to its prediction minus its base.
    """
    features, rng = list(features), np.random.default_rng(seed)
    k = len(features)
    n_orders = math.factorial(k)
    if n_orders <= n_permutations:  # all orders in turn
        orders = list(itertools.islice(itertools.cycle(map(list, itertools.permutations(range(k)))), n_permutations))
    else:
        orders = [list(map(int, rng.permutation(k))) for _ in range(n_permutations)]
    backs = (df.select(*features).withColumn("_h", F.xxhash64(*features, F.lit(seed))).orderBy("_h", *features).limit(n_permutations).drop("_h").collect())
    plan = df.sparkSession.createDataFrame(
        [(i, orders[i], [float(v) for v in backs[(i + i // n_orders) % len(backs)]]) for i in range(n_permutations)], "_perm int, _order array<int>, _back array<double>")
    rows = df.select(key, *features).withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
    rows = rows.join(F.broadcast(plan), "_perm").withColumn("_stage", F.explode(F.sequence(F.lit(0), F.lit(k))))
    taken = [F.array_position("_order", F.lit(i)) <= F.col("_stage") for i in range(k)]
    # a feature's step is the score of the stage that takes it less that of the stage before: signed scores, summed by key before they leave the task
    at = [F.array_position("_order", F.lit(i)) for i in range(k)]
    signs = F.array(*[(F.col("_stage") == p).cast("int") - (F.col("_stage") == p - 1).cast("int") for p in at])
    staged = rows.select(key, "_stage", signs.alias("_signs"), *[F.col(f).cast("double").alias(f"_own_{f}") for f in features],
                         *[F.when(taken[i], F.col(f).cast("double")).otherwise(F.col("_back")[i]).alias(f) for i, f in enumerate(features)])
    scored = predict(staged).select(key, "_stage", "_signs", "yhat", *[f"_own_{f}" for f in features])
    whole = scored.groupBy(key).agg(
        F.max(F.when(F.col("_stage") == k, F.col("yhat"))).alias("yhat"), F.avg(F.when(F.col("_stage") == 0, F.col("yhat"))).alias("base"),
        F.count_if(F.col("_stage") == 0).alias("_n"), *[F.max(f"_own_{f}").alias(f"_own_{f}") for f in features],
        *[F.sum(F.col("yhat") * F.col("_signs")[i]).alias(f"_sum_{i}") for i in range(k)])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_own_{f}").alias("value"), (F.col(f"_sum_{i}") / F.col("_n")).alias("attribution"))
                      for i, f in enumerate(features)])
    return whole.select(key, "yhat", "base", F.inline(cells)).select(key, "feature", "value", "attribution", "yhat", "base")


def global_attribution(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution of each feature, largest first."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature")
