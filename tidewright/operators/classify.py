"""Scores of ordinal, imbalanced and probabilistic classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.columns import clip, hash_unit
from tidewright.operators.ordering import attach, sorted_scan
from tidewright.session import settle


def to_grade(score: Column, lowest: int, highest: int) -> Column:
    """Half-even rounding of a score, held within the grades."""
    return clip(F.rint(score), float(lowest), float(highest)).cast("int")


def confusion(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of (actual, predicted), the only pass over the rows that the grade scores need."""
    return df.groupBy(*keys, F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))


def grade_report(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro-F1, mean absolute distance and quadratic weighted kappa from a confusion table."""
    keys, cells = list(keys), settle(cells)
    a, p, n = F.col("actual").cast("double"), F.col("predicted").cast("double"), F.col("n")
    base = cells.groupBy(*keys).agg(
        F.sum(n).alias("n"), F.sum(F.when(a == p, n).otherwise(0)).alias("_hit"), F.sum(F.abs(a - p) * n).alias("_abs"),
        F.sum((a - p) ** 2 * n).alias("_sq"), F.sum(a * n).alias("_sa"), F.sum(p * n).alias("_sp"), F.sum(a * a * n).alias("_saa"), F.sum(p * p * n).alias("_spp"))
    long = cells.select(*keys, F.inline(F.array(
        F.struct(F.col("actual").alias("grade"), F.when(a == p, n).otherwise(0).alias("tp"), n.alias("support"), F.lit(0).cast("bigint").alias("called")),
        F.struct(F.col("predicted").alias("grade"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), n.alias("called")))))
    per = long.groupBy(*keys, "grade").agg(F.sum("tp").alias("tp"), F.sum("support").alias("s"), F.sum("called").alias("c"))
    macro = per.groupBy(*keys).agg(F.avg(2.0 * F.col("tp") / (F.col("s") + F.col("c"))).alias("macro_f1"))
    both = attach(base, macro, keys)
    total = F.col("n")
    # expected squared distance of independent margins
    expected = F.col("_saa") + F.col("_spp") - 2 * F.col("_sa") * F.col("_sp") / total
    kappa = 1 - F.col("_sq") / F.nullif(expected, F.lit(0.0))
    return both.select(*keys, "n", (F.col("_hit") / total).alias("accuracy"), "macro_f1", (F.col("_abs") / total).alias("mae"), kappa.alias("kappa"))


def confusion_shares(cells: DataFrame) -> DataFrame:
    """Row shares of a confusion table."""
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def within_one(cells: DataFrame) -> DataFrame:
    near = F.abs(F.col("actual") - F.col("predicted")) <= 1
    return cells.agg(F.sum("n").alias("n"), (F.sum(F.when(near, F.col("n")).otherwise(0)) / F.sum("n")).alias("within_one"))


def class_recall(cells: DataFrame) -> DataFrame:
    """Recall and support of each actual grade."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    return cells.groupBy("actual").agg(F.sum("n").alias("support"), (hit / F.sum("n")).alias("recall"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes · class size) of each class."""
    counts = settle(df.groupBy(label).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    return attach(counts, total).select(label, "n", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))


def oversample(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Every class brought to the size of the largest: whole copies, then a hash-drawn remainder."""
    counts = settle(df.groupBy(label).agg(F.count("*").alias("_m")))
    sizes = attach(counts, counts.agg(F.max("_m").alias("_top")))
    rows = attach(df, sizes, [label])
    rows = sorted_scan(rows, [label], [F.xxhash64(key, F.lit(seed)), F.col(key)], row_number="_place")
    extra = F.col("_place") <= F.col("_top") % F.col("_m")
    copies = F.floor(F.col("_top") / F.col("_m")) + F.when(extra, 1).otherwise(0)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies.cast("bigint"))))
    return rows.drop("_m", "_top", "_place")


def majority_class(train: DataFrame, label: str) -> DataFrame:
    """The most frequent class (smallest on ties), in one row."""
    counts = train.groupBy(label).agg(F.count("*").alias("_n"))
    return counts.agg(F.max_by(label, F.struct("_n", -F.col(label))).alias("majority"))


def random_class(df: DataFrame, train: DataFrame, label: str, key: str, out: str, seed: int = 0) -> DataFrame:
    """A class drawn by hash with the training shares (classes are few and fixed)."""
    counts = train.groupBy(label).agg(F.count("*").alias("_n"))
    scanned = sorted_scan(counts, [], [F.col(label)], {"_cum": "_n"}, bounded=True)
    bands = scanned.agg(F.array_sort(F.collect_list(F.struct("_cum", F.col(label).alias("_c")))).alias("_bands"), F.sum("_n").alias("_total"))
    rows = attach(df, bands)
    u = hash_unit(F.col(key), seed=seed)
    pick = F.element_at(F.filter("_bands", lambda b: b["_cum"] > u * F.col("_total")), 1)["_c"]
    return rows.withColumn(out, pick).drop("_bands", "_total")


# ------------------------------------------------------------------ probabilities
def _score_cells(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(p).alias("_p")).agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) != 1).alias("_neg"))


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the ROC curve as a rank sum; equal scores count one half."""
    scanned = sorted_scan(_score_cells(df, y, p), [], [F.col("_p")], {"_below": "_neg"})
    below = F.col("_below") - F.col("_neg")
    one = scanned.agg(F.sum(F.col("_pos") * (below + F.col("_neg") / 2)).alias("_s"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    return one.select("n_pos", "n_neg", (F.col("_s") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0)).cast("double")).alias("auc"))


def pr_curve(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision and recall at each distinct score, highest first."""
    rows = sorted_scan(_score_cells(df, y, p), [], [F.col("_p").desc()], {"tp": "_pos", "fp": "_neg"}, totals=True)
    return rows.select(F.col("_p").alias("score"), "tp", "fp", F.col("_pos").alias("hits"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                       (F.col("tp") / F.nullif(F.col("tp_total"), F.lit(0))).alias("recall"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Sum of precision over the recall steps of a PR curve."""
    return curve.agg((F.sum(F.col("hits") * F.col("precision")) / F.nullif(F.sum("hits"), F.lit(0))).alias("average_precision"))


def reliability(df: DataFrame, y: str, p: str, k: int = 10) -> DataFrame:
    """Mean score and observed rate in k equal score bands; the last band is closed."""
    band = F.least(F.floor(F.col(p) * k), F.lit(k - 1)).cast("int")
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("observed"))


def calibration_error(bands: DataFrame) -> DataFrame:
    """Expected calibration error from a reliability table."""
    return bands.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("observed"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))


def threshold_table(df: DataFrame, y: str, p: str, thresholds: Sequence[float]) -> DataFrame:
    """Flagged rows, hit rate and recall at each decision threshold."""
    aggs = [F.count_if(F.col(y) == 1).alias("_all")]
    for i, th in enumerate(thresholds):
        aggs += [F.count_if(F.col(p) >= th).alias(f"_f{i}"), F.count_if((F.col(p) >= th) & (F.col(y) == 1)).alias(f"_h{i}")]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(float(th)).alias("threshold"), F.col(f"_f{i}").alias("flagged"), (F.col(f"_h{i}") / F.nullif(F.col(f"_f{i}"), F.lit(0))).alias("hit_rate"),
                 (F.col(f"_h{i}") / F.nullif(F.col("_all"), F.lit(0))).alias("recall")) for i, th in enumerate(thresholds)])))
