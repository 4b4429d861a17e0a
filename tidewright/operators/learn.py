"""Ordinal, imbalanced and probabilistic learning on top of pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewright.functions.columns import hash_unit
from tidewright.operators.classify import confusion, grade_report, to_grade
from tidewright.operators.forecast import assemble
from tidewright.operators.neighbours import nearest
from tidewright.operators.ordering import quantiles, sorted_scan
from tidewright.session import settle


# ------------------------------------------------------------------ classifiers
def classifier(kind: str, label: str, weight: str | None = None, depth: int = 5, rounds: int = 20, trees: int = 30, seed: int = 0):
    """Logistic regression, random forest, boosted binary trees, or one-vs-rest boosted trees."""
    common = {"featuresCol": "_features", "labelCol": label, **({"weightCol": weight} if weight else {})}
    if kind == "logistic":
        return LogisticRegression(maxIter=50, **common)
    if kind == "forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **common)
    boosted = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, **common)
    if kind == "boosted":
        return boosted
    return OneVsRest(classifier=boosted, parallelism=2, **common)


def _most_certain(model: OneVsRestModel, rows: DataFrame) -> DataFrame:
    """``_best``: the class whose model is surest (the first of equals), as ``OneVsRestModel.transform`` has it, but without its Python function per class and row."""
    sure = []
    for k, one in enumerate(model.models):
        one = one.copy().setRawPredictionCol(f"_raw{k}").setPredictionCol("").setProbabilityCol("")
        rows = one.transform(rows)
        sure.append(vector_to_array(f"_raw{k}")[1])
    rows = rows.withColumn("_sure", F.array(*sure))
    return rows.withColumn("_best", (F.array_position("_sure", F.array_max("_sure")) - 1).cast("double"))


def score(model, df: DataFrame, features: Sequence[str], out: str = "prediction", prob: str | None = None) -> DataFrame:
    """Predictions (and the probability of class 1 as ``prob``)."""
    rows = assemble(df, features)
    if isinstance(model, OneVsRestModel):
        return _most_certain(model, rows).select(*df.columns, F.col("_best").alias(out))
    rows = model.transform(rows)
    if prob:
        rows = rows.withColumn(prob, vector_to_array("probability")[1])
    rows = rows.withColumn(out, F.col("prediction"))
    return rows.select(*df.columns, out, *([prob] if prob else []))


def folds_report(df: DataFrame, features: Sequence[str], label: str, fold: str, make, lowest: int, highest: int, n_folds: int) -> DataFrame:
    """Fit on all folds but one, score the one: a grade report for each fold."""
    out = None
    for k in range(n_folds):
        model = make().fit(assemble(df.filter(F.col(fold) != k), features))
        rows = score(model, df.filter(F.col(fold) == k), features, "_p").withColumn("_g", to_grade(F.col("_p"), lowest, highest))
        rep = grade_report(confusion(rows, label, "_g")).withColumn("fold", F.lit(k))
        out = rep if out is None else out.unionByName(rep)
    return out


def mean_and_spread(reports: DataFrame, cols: Sequence[str]) -> DataFrame:
    return reports.agg(*[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}_sd") for c in cols])


# ------------------------------------------------------------------ ordinal targets
def score_table(df: DataFrame, score_col: str, grade: str, step: float = 0.02) -> DataFrame:
    """Counts by score bin and grade: all a cut-point search needs, and of bounded size."""
    return df.groupBy(F.floor(F.col(score_col) / step).cast("int").alias("bin"), F.col(grade).alias("grade")).agg(F.count("*").alias("n"))


def best_cuts(df: DataFrame, score_col: str, grade: str, grades: Sequence[int], step: float = 0.02, rounds: int = 20) -> list[float]:
    """Cut points that maximise quadratic kappa, by coordinate search over the binned counts."""
    rows = score_table(df, score_col, grade, step).collect()
    edge = np.array([r["bin"] for r in rows]) * step
    actual, n = np.array([r["grade"] for r in rows], dtype=float), np.array([r["n"] for r in rows], dtype=float)
    labels = np.asarray(grades, dtype=float)

    def kappa(cuts):
        p = labels[np.digitize(edge, cuts)]
        seen = (n * (actual - p) ** 2).sum()
        sa, sp, total = (n * actual).sum(), (n * p).sum(), n.sum()
        chance = (n * actual ** 2).sum() + (n * p ** 2).sum() - 2 * sa * sp / total
        return 1 - seen / chance if chance > 0 else 0.0

    cuts, best, move = labels[:-1] + 0.5, None, 0.5
    best = kappa(cuts)
    for _ in range(rounds):
        changed = False
        for i in range(len(cuts)):
            for delta in (-move, move):
                trial = cuts.copy()
                trial[i] += delta
                if (np.diff(trial) > 0).all() and kappa(trial) > best + 1e-12:
                    cuts, best, changed = trial, kappa(trial), True
        if not changed:
            move /= 2
            if move < step:
                break
    return [float(c) for c in cuts]


def apply_cuts(df: DataFrame, score_col: str, cuts: Sequence[float], grades: Sequence[int], out: str) -> DataFrame:
    """Grade by cut points; a score equal to a cut takes the higher grade."""
    place = sum(((F.col(score_col) >= F.lit(float(c))).cast("int") for c in sorted(cuts)), F.lit(0))
    return df.withColumn(out, F.element_at(F.array(*[F.lit(int(g)) for g in grades]), place + 1))


def ordinal_by_thresholds(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, grades: Sequence[int], make) -> DataFrame:
    """K − 1 binary models of "above grade c"; differences of their probabilities give each grade's share."""
    rows = test
    for c in grades[:-1]:
        fit = make("_above").fit(assemble(train.withColumn("_above", (F.col(label) > c).cast("double")), features))
        rows = score(fit, rows, features, "_drop", prob=f"_over_{c}").drop("_drop")
    over = [F.lit(1.0), *[F.col(f"_over_{c}") for c in grades[:-1]], F.lit(0.0)]
    shares = [F.greatest(over[i] - over[i + 1], F.lit(0.0)) for i in range(len(grades))]
    expected = F.lit(float(grades[0])) + sum((F.col(f"_over_{c}") for c in grades[:-1]), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(s.alias("p"), F.lit(-int(g)).alias("g")) for s, g in zip(shares, grades, strict=True)]))
    return rows.withColumn("expected_grade", expected).withColumn("grade_hat", -best["g"]).drop(*[f"_over_{c}" for c in grades[:-1]])


# ------------------------------------------------------------------ imbalance
def _drawn(rows: DataFrame, sizes: dict, wanted: dict, label: str, key: str, features: Sequence[str], k: int, seed: int) -> DataFrame:
    """(``label``, new_id, features): ``wanted`` synthetic rows of each class, all classes in one search; only rows that are drawn from look for neighbours."""
    spark, kind = rows.sparkSession, rows.schema[label].dataType
    table = spark.createDataFrame([(c, sizes[c], n) for c, n in wanted.items()], StructType([StructField(label, kind), StructField("_size", LongType()), StructField("_new", LongType())]))
    pool = settle(rows.join(F.broadcast(table), label))
    placed = settle(sorted_scan(pool, [label], [F.xxhash64(key, F.lit(seed)), F.col(key)], row_number="_place").filter(F.col("_place") <= F.col("_new")))
    near = nearest(placed, pool, key, key, features, k, [label], exclude_same_id=True)
    draws = placed.withColumn("new_id", F.explode(F.sequence(F.col("_place") - 1, F.col("_new") - 1, F.col("_size"))))
    draws = draws.withColumns({"place": (F.floor(hash_unit(F.col("new_id"), seed=seed + 1) * F.least(F.lit(k), F.col("_size") - 1)) + 1).cast("int"),
                               "_u": hash_unit(F.col("new_id"), seed=seed + 2)})
    other = pool.select(label, F.col(key).alias(f"{key}_near"), *[F.col(f).alias(f"_o_{f}") for f in features])
    both = draws.join(near.select(label, key, f"{key}_near", "place"), [label, key, "place"]).join(other, [label, f"{key}_near"])
    return both.select(label, "new_id", *[(F.col(f) + F.col("_u") * (F.col(f"_o_{f}") - F.col(f))).alias(f) for f in features])


def smote(df: DataFrame, label: str, minority, key: str, features: Sequence[str], n_new: int, k: int = 5, seed: int = 0) -> DataFrame:
    """Synthetic minority rows on the lines between a row and one of its k nearest minority rows."""
    pool = settle(df.filter(F.col(label) == minority).select(label, key, *[F.col(f).cast("double").alias(f) for f in features]))
    return _drawn(pool, {minority: pool.count()}, {minority: n_new}, label, key, features, k, seed).select("new_id", label, *features)


def smote_balanced(df: DataFrame, label: str, key: str, features: Sequence[str], k: int = 5, seed: int = 0) -> DataFrame:
    """(``label``, ``new_id``, features): all rows (``new_id`` null) and as many synthetic ones as bring each class to the size of the largest.

    A class of one row has no neighbours to draw lines to: that row is repeated. Rows without a label are left out.
    """
    rows = settle(df.filter(F.col(label).isNotNull()).select(label, key, *[F.col(f).cast("double").alias(f) for f in features]))
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    most = max(sizes.values(), default=0)
    out = rows.select(label, F.lit(None).cast("long").alias("new_id"), *features)
    wanted = {c: most - n for c, n in sorted(sizes.items()) if 1 < n < most}
    if wanted:
        out = out.unionByName(_drawn(rows, sizes, wanted, label, key, features, k, seed))
    for c, n in sorted(sizes.items()):
        if n == 1 < most:
            made = df.sparkSession.range(most - n).withColumnRenamed("id", "new_id").crossJoin(rows.filter(F.col(label) == c))
            out = out.unionByName(made.select(label, "new_id", *features))
    return out


# ------------------------------------------------------------------ losses and quantiles
def count_model(df: DataFrame, features: Sequence[str], label: str, family: str = "poisson", power: float = 1.5):
    """Generalised linear model with a log link under a Poisson or Tweedie loss."""
    extra = {"variancePower": power, "linkPower": 0.0} if family == "tweedie" else {"link": "log"}
    glm = GeneralizedLinearRegression(family=family, featuresCol="_features", labelCol=label, predictionCol="yhat", maxIter=25, regParam=1e-6, **extra)
    return glm.fit(assemble(df, features))


def forest_quantiles(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, levels: dict[str, float], trees: int = 10,
                     depth: int = 4, seed: int = 0) -> DataFrame:
    """Conditional quantiles: each tree's leaf gives the quantile of its training rows, trees are averaged.

    Leaf quantiles are exact and rise with the level, so the averages never cross.
    """
    forest = RandomForestRegressor(featuresCol="_features", labelCol=label, predictionCol="_p", leafCol="_leaf", numTrees=trees, maxDepth=depth,
                                   minInstancesPerNode=20, seed=seed)
    model = forest.fit(assemble(train, features))

    def leaves(df):
        rows = model.transform(assemble(df, features)).withColumn("_leaves", vector_to_array("_leaf"))
        return rows.drop("_features", "_p", "_leaf")

    held = leaves(train).select(F.col(label).alias("_y"), F.posexplode("_leaves").alias("_tree", "_leaf"))
    table = settle(quantiles(settle(held), ["_tree", "_leaf"], "_y", levels))
    rows = settle(leaves(test).withColumn("_row", F.monotonically_increasing_id()))
    open_rows = rows.select("_row", F.posexplode("_leaves").alias("_tree", "_leaf")).join(F.broadcast(table), ["_tree", "_leaf"])
    means = open_rows.groupBy("_row").agg(*[F.avg(n).alias(n) for n in levels])
    return rows.drop("_leaves").join(means, "_row").drop("_row")


# ------------------------------------------------------------------ calibration
def cross_fitted_scores(df: DataFrame, features: Sequence[str], label: str, fold: str, n_folds: int, make) -> DataFrame:
    """Out-of-fold probability ``raw`` of class 1 for every row."""
    out = None
    for k in range(n_folds):
        model = make().fit(assemble(df.filter(F.col(fold) != k), features))
        part = score(model, df.filter(F.col(fold) == k), features, "_drop", prob="raw").drop("_drop")
        out = part if out is None else out.unionByName(part)
    return settle(out)


def calibrate(scored: DataFrame, label: str, fold: str, n_folds: int, method: str) -> DataFrame:
    """Map ``raw`` to ``calibrated`` by Platt scaling or isotonic regression, fitted on the other folds: on distinct scores with their counts as weights."""
    logit = F.log(F.greatest("raw", F.lit(1e-6)) / F.greatest(1 - F.col("raw"), F.lit(1e-6)))
    rows = assemble(scored.withColumn("_logit", logit if method == "platt" else F.col("raw")).withColumn("_y", F.col(label).cast("double")), ["_logit"])
    out = None
    counts = settle(rows.groupBy(fold, "_logit", "_y").agg(F.count("*").cast("double").alias("_n")))
    for k in range(n_folds):
        use = rows.filter(F.col(fold) == k)
        fit_rows = assemble(counts.filter(F.col(fold) != k).groupBy("_logit", "_y").agg(F.sum("_n").alias("_n")), ["_logit"])
        if method == "platt":
            fit = LogisticRegression(featuresCol="_features", labelCol="_y", weightCol="_n").fit(fit_rows)
            part = fit.transform(use).withColumn("calibrated", vector_to_array("probability")[1])
        else:
            fit = IsotonicRegression(featuresCol="_features", labelCol="_y", predictionCol="_iso", weightCol="_n").fit(fit_rows)
            part = fit.transform(use).withColumn("calibrated", F.col("_iso"))
        part = part.select(*scored.columns, "calibrated")
        out = part if out is None else out.unionByName(part)
    return out


