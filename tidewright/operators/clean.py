"""Row-level cleaning and audits that need one pass or one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.ordering import attach


def coercion_failures(df: DataFrame, raw: str, parsed: str, beside: str) -> DataFrame:
    """How many texts failed to parse, and the values another column takes on those rows."""
    bad = df.filter(F.col(parsed).isNull() & F.col(raw).isNotNull())
    return bad.groupBy(beside).agg(F.count("*").alias("n_failed"))


def audit(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Count the rows that meet each condition, in one pass: ``(check_name, n)``."""
    one = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return one.unpivot([], list(checks), "check_name", "n")


def exact_copies(df: DataFrame, cols: Sequence[str] | None = None, digest: Sequence[str] = ()) -> DataFrame:
    """Distinct rows with how often each occurs; combined before the shuffle, so hot rows are cheap.

    Columns named in ``digest`` (long texts) are compared by their SHA-256 over the whole value, so the
    shuffle carries 64 characters instead of the text.
    """
    keys = [F.sha2(F.col(c), 256).alias(c) if c in digest else F.col(c) for c in (cols or df.columns)]
    return df.groupBy(*keys).agg(F.count("*").alias("copies"))


def keep_first(df: DataFrame, keys: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """One row per key, the earliest by ``tiebreak``; an aggregate with map-side combine, no window."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*tiebreak)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*")


def standardise(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), suffix: str = "_z",
                population: bool = False) -> DataFrame:
    """z-scores by full-sample mean and standard deviation, of all rows or of each key."""
    sd = F.stddev_pop if population else F.stddev_samp
    stats = df.groupBy(*keys).agg(*[F.avg(c).alias("_m_" + c) for c in cols], *[sd(c).alias("_s_" + c) for c in cols])
    rows = attach(df, stats, keys)
    z = [((F.col(c) - F.col("_m_" + c)) / F.nullif(F.col("_s_" + c), F.lit(0.0))).alias(c + suffix) for c in cols]
    return rows.select(*df.columns, *z)


def rebase(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Values divided by the first one of each key."""
    first = df.groupBy(*keys).agg(F.min_by(value, order).alias("_first"))
    return attach(df, first, keys).withColumn(out, F.col(value) / F.col("_first")).drop("_first")


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """``n`` rows by smallest hash: the same rows whatever the partitioning."""
    return df.withColumn("_h", key).orderBy("_h", *df.columns).limit(n).drop("_h")


def profile(df: DataFrame, cols: Sequence[str], approximate: bool = True) -> DataFrame:
    """Nulls, distinct values, zeros, smallest and largest of numeric columns, one row per column."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    aggs = [F.count("*").alias("_rows")]
    for c in cols:
        aggs += [F.count(c).alias("n_" + c), distinct(c).alias("d_" + c),
                 F.count_if(F.col(c) == 0).alias("z_" + c),
                 F.min(c).cast("double").alias("lo_" + c), F.max(c).cast("double").alias("hi_" + c)]
    one = df.agg(*aggs)
    entries = [F.struct(F.lit(c).alias("column"), (F.col("_rows") - F.col("n_" + c)).alias("n_missing"),
                        F.col("d_" + c).alias("n_distinct"),
                        (F.col("z_" + c) * 100.0 / F.col("n_" + c)).alias("pct_zero"),
                        F.col("lo_" + c).alias("lo"), F.col("hi_" + c).alias("hi")) for c in cols]
    return one.select(F.inline(F.array(*entries)))
