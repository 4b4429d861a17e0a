"""Distribution profiles: moments, quantile tables, histograms, ranks, normality and outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.columns import normal_quantile
from tidewright.operators.ordering import attach, quantiles, sorted_scan, value_counts
from tidewright.session import settle


def unbiased_skew(c: str | Column, n: Column) -> Column:
    """Sample skewness with the usual small-sample factor (needs n > 2)."""
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2))


def unbiased_kurtosis(c: str | Column, n: Column) -> Column:
    """Sample excess kurtosis with the small-sample correction (needs n > 3)."""
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def moments(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, std, skew, excess kurtosis, smallest, median and largest value of each group."""
    n = F.count(value)
    stats = df.groupBy(*keys).agg(
        n.alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        unbiased_skew(value, n).alias("skew"), unbiased_kurtosis(value, n).alias("excess_kurtosis"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    return attach(stats, quantiles(df, keys, value, {"median": 0.5}), keys)


def normality(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Jarque–Bera and D'Agostino–Pearson statistics with p-values, from one aggregate."""
    one = df.groupBy(*keys).agg(F.count(value).cast("double").alias("n"), F.skewness(value).alias("g1"),
                                F.kurtosis(value).alias("g2"))
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    jb = n / 6 * (g1 * g1 + g2 * g2 / 4)
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    shape = y / F.sqrt(2 / (w2 - 1))
    z_skew = F.log(shape + F.sqrt(shape * shape + 1)) / F.sqrt(0.5 * F.log(w2))
    mean_k = 3 * (n - 1) / (n + 1)
    var_k = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean_k) / F.sqrt(var_k)
    skew_b2 = (6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
               * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))
    a = 6 + 8 / skew_b2 * (2 / skew_b2 + F.sqrt(1 + 4 / (skew_b2 * skew_b2)))
    inner = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    root = F.signum(inner) * F.pow(F.abs(inner), F.lit(1 / 3))
    z_kurt = (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))
    k2 = z_skew * z_skew + z_kurt * z_kurt
    return one.select(*keys, "n", jb.alias("jb"), F.exp(-jb / 2).alias("jb_p"), k2.alias("k2"), F.exp(-k2 / 2).alias("k2_p"))


def mad(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Median and median absolute deviation."""
    med = settle(quantiles(df, keys, value, {"median": 0.5}))
    rows = attach(df.select(*keys, value), med, keys).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    return attach(med, quantiles(rows, keys, "_dev", {"mad": 0.5}), keys)


def outlier_flags(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with Tukey fences (1.5 IQR) and modified z (MAD, 3.5) flags; a zero MAD flags nothing."""
    q = settle(quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    dev = attach(df.select(*keys, value), q, keys).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    q = attach(q, quantiles(dev, keys, "_dev", {"mad": 0.5}), keys)
    rows = attach(df, q, keys)
    v, spread = F.col(value), 1.5 * (F.col("q3") - F.col("q1"))
    z = 0.6745 * (v - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0))
    return rows.select(*df.columns, ((v < F.col("q1") - spread) | (v > F.col("q3") + spread)).alias("iqr_outlier"),
                       F.coalesce(F.abs(z) > 3.5, F.lit(False)).alias("mad_outlier"))


def histogram(df: DataFrame, value: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """k equal bins between the smallest and largest value; the last bin is closed."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * k)
    rows = attach(df.filter(F.col(value).isNotNull()), ends, keys)
    return rows.groupBy(*keys, F.least(F.coalesce(place, F.lit(0)), F.lit(k - 1)).cast("bigint").alias("bin")).agg(
        F.count("*").alias("n"))


def histogram2d(df: DataFrame, a: str, b: str, ka: int, kb: int) -> DataFrame:
    """Counts on a ka × kb grid over the ranges of both columns."""
    ends = df.agg(F.min(a).alias("_alo"), F.max(a).alias("_ahi"), F.min(b).alias("_blo"), F.max(b).alias("_bhi"))
    rows = attach(df.select(a, b).na.drop(), ends)

    def place(c, lo, hi, k):
        return F.least(F.floor((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)) * k), F.lit(k - 1)).cast("bigint")

    return rows.groupBy(place(a, "_alo", "_ahi", ka).alias("bin_a"), place(b, "_blo", "_bhi", kb).alias("bin_b")).agg(
        F.count("*").alias("n"))


def ecdf(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative share at each distinct value."""
    rows = sorted_scan(value_counts(df, keys, value), keys, [F.col(value)], {"_cum": "_n"}, totals=True)
    return rows.select(*keys, value, (F.col("_cum") / F.col("_cum_total")).alias("share"))


def box_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Quartiles, Tukey fences and the number of values beyond them."""
    q = quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn(
        "hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    out = attach(df, q, keys).groupBy(*keys).agg(
        F.count_if((F.col(value) < F.col("lo_fence")) | (F.col(value) > F.col("hi_fence"))).alias("n_beyond"))
    return attach(q, out, keys)


def qq_points(df: DataFrame, value: str, tiebreak: str) -> DataFrame:
    """Ordered values beside normal quantiles at Filliben's order statistic medians."""
    rows = sorted_scan(df.select(value, tiebreak).na.drop(), [], [F.col(value), F.col(tiebreak)], row_number="place", totals=True)
    i, n = F.col("place"), F.col("place_total")
    edge = F.pow(F.lit(0.5), 1 / n)
    p = F.when(i == 1, 1 - edge).when(i == n, edge).otherwise((i - 0.3175) / (n + 0.365))
    return rows.select(tiebreak, value, "place", p.alias("p"), normal_quantile(p).alias("theoretical"))


def exceedance_curve(df: DataFrame, value: str, tiebreak: Sequence[str]) -> DataFrame:
    """Values from largest to smallest with the per cent of rows placed before each."""
    order = [F.col(value).desc(), *[F.col(c) for c in tiebreak]]
    rows = sorted_scan(df.filter(F.col(value).isNotNull()), [], order, row_number="place", totals=True)
    return rows.withColumn("pct_exceeding", (F.col("place") - 1) * 100.0 / F.col("place_total")).drop("place_total")


def frequencies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and shares of each value."""
    counts = settle(df.groupBy(*keys).agg(F.count("*").alias("n")))
    return attach(counts, counts.agg(F.sum("n").alias("_total"))).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table with the share of each cell in its row."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return cells.withColumn("row_pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(a)))


def skew_table(df: DataFrame, variants: Mapping[str, Column]) -> DataFrame:
    """Skewness of several transforms of a column, one row per transform."""
    one = df.select(*[c.alias(n) for n, c in variants.items()])
    one = one.agg(*[unbiased_skew(n, F.count(n)).alias(n) for n in variants])
    return one.unpivot([], list(variants), "transform", "skew")


def ks_two_sample(df: DataFrame, value: str, flag: str) -> DataFrame:
    """Largest gap between the distribution functions of flagged and unflagged rows."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(value).agg(
        F.count_if(F.col(flag)).alias("_a"), F.count_if(~F.col(flag)).alias("_b"))
    rows = sorted_scan(cells, [], [F.col(value)], {"_ca": "_a", "_cb": "_b"}, totals=True)
    gap = F.abs(F.col("_ca") / F.col("_ca_total") - F.col("_cb") / F.col("_cb_total"))
    return rows.agg(F.max("_ca_total").alias("n_flagged"), F.max("_cb_total").alias("n_rest"), F.max(gap).alias("ks"))


def ks_p_value(ks: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic p-value by the first terms of the Kolmogorov series."""
    lam = F.sqrt(n1 * n2 / (n1 + n2)) * ks
    total = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 51)), F.lit(0.0))
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def calendar_composition(df: DataFrame, regime: str, ts: str) -> DataFrame:
    """Share of each weekday (1 = Monday) and month within each regime, beside its share of all rows.

    Returns (regime, part, item, n, pct, all_pct, lift), ``part`` being weekday or month. Rows without a date take no part; a null regime is one of its own.
    Rows are counted once, per regime and day of the calendar; all else works on these few counts.
    """
    day = F.col(ts).cast("date")
    cells = df.where(day.isNotNull()).groupBy(F.col(regime).alias("regime"), (F.weekday(day) + 1).alias("weekday"), F.month(day).alias("month")).agg(F.count("*").alias("n"))
    parts = F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("item")) for c in ("weekday", "month")])
    rows = cells.select("regime", F.inline(parts), "n").groupBy("regime", "part", "item").agg(F.sum("n").alias("n"))

    def total(*by):
        return F.sum("n").over(Window.partitionBy(*by))

    pct, base = 100 * F.col("n") / total("regime", "part"), 100 * total("part", "item") / total("part")
    return rows.select(F.col("regime").alias(regime), "part", "item", "n", pct.alias("pct"), base.alias("all_pct"), (pct / base).alias("lift"))
