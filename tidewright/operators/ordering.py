"""Ordered work that stays distributed when one series or one value range holds most rows.

Two forms are used throughout the library:

* **Blocks on a grid.** A series on a regular grid is cut into blocks of slots. Look-backs of
  bounded length copy the edge rows into the neighbouring block (a halo), so each window task sees
  one block and never a whole series. Running totals and fills carry one summary row per block.
* **Sorted scan.** Any other order (values, scores, hashes) is range-sorted by Spark, stored, and
  scanned per stored partition; the offsets between partitions come from one small aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import settle

BLOCK = 4096


# ------------------------------------------------------------------ blocks on a grid
def _home(pos: str, block: int) -> Column:
    return F.floor(F.col(pos) / block).cast("long")


def with_halo(df: DataFrame, pos: str, back: int = 0, ahead: int = 0, block: int = BLOCK) -> DataFrame:
    """Add ``_home`` and ``_block``; edge rows are copied into the block that will look at them."""
    block = max(block, back, ahead, 1)
    home, inside = _home(pos, block), F.pmod(F.col(pos), F.lit(block))
    copies = [home]
    if back:
        copies.append(F.when(inside >= block - back, home + 1))
    if ahead:
        copies.append(F.when(inside < ahead, home - 1))
    out = df.withColumn("_home", home)
    if len(copies) == 1:
        return out.withColumn("_block", F.col("_home"))
    return out.withColumn("_block", F.explode(F.array_compact(F.array(*copies))))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("_home = _block").drop("_home", "_block")


def lag_of(col: str | Column, k: int = 1):
    """Spec: the value ``k`` slots earlier (negative ``k``: later)."""
    return ("lag", col, k, 0)


def rolling(kind: str, col: str | Column, width: int, offset: int = 0):
    """Spec: ``kind`` over ``width`` slots ending ``offset`` slots ago; null until the window is full.

    ``kind`` is mean, std, sum, min, max, count or ``any_<kind>`` to accept windows that are not full.
    """
    return (kind, col, width, offset)


def centred(kind: str, col: str | Column, before: int, after: int):
    """Spec: ``kind`` over ``before`` slots back to ``after`` slots ahead, full windows only."""
    return ("centred_" + kind, col, before, after)


_AGG = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max,
        "count": F.count, "median": F.median}


def look_around(df: DataFrame, series_cols: Sequence[str], pos: str, specs: Mapping[str, tuple],
                block: int = BLOCK) -> DataFrame:
    """Add every lag and rolling column in ``specs`` with one shuffle and one sort.

    Offsets are counted in grid slots, so an absent slot is a missing value and not a shorter lag.
    """
    back = ahead = 0
    for kind, _, a, b in specs.values():
        if kind == "lag":
            back, ahead = max(back, a), max(ahead, -a)
        elif kind.startswith("centred_"):
            back, ahead = max(back, a), max(ahead, b)
        else:
            back, ahead = max(back, a + b - 1), max(ahead, -b)
    w = Window.partitionBy(*series_cols, "_block").orderBy(pos)
    cols = []
    for name, (kind, col, a, b) in specs.items():
        c = F.col(col) if isinstance(col, str) else col
        if kind == "lag":
            cols.append(F.first(c).over(w.rangeBetween(-a, -a)).alias(name))
            continue
        if kind.startswith("centred_"):
            frame, width, kind = w.rangeBetween(-a, b), a + b + 1, kind[len("centred_"):]
        else:
            frame, width = w.rangeBetween(-(a + b - 1), -b), a
        if kind.startswith("any_"):
            cols.append(_AGG[kind[4:]](c).over(frame).alias(name))
        else:
            cols.append(F.when(F.count(c).over(frame) == width, _AGG[kind](c).over(frame)).alias(name))
    return drop_halo(with_halo(df, pos, back, ahead, block).select("*", *cols))


def running(df: DataFrame, series_cols: Sequence[str], pos: str, sums: Mapping[str, str | Column] = (),
            last: Mapping[str, str] = (), following: Mapping[str, str] = (), block: int = BLOCK) -> DataFrame:
    """Whole-series running columns without putting a series into one task.

    ``sums``: running totals. ``last`` / ``following``: a struct ``(pos, value)`` of the nearest
    non-null value at or before / at or after each row. Per-block summaries (one row for
    ``block`` slots) are scanned and joined back on the same keys the local window uses.
    """
    sums, last, following = dict(sums), dict(last), dict(following)
    keys = [*series_cols, "_block"]
    rows = df.withColumn("_block", _home(pos, block))
    for name, c in sums.items():
        rows = rows.withColumn("_in_" + name, F.col(c) if isinstance(c, str) else c)
    pair = {n: F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("pos"), F.col(c).alias("value")))
            for n, c in {**last, **following}.items()}
    aggs = [F.sum("_in_" + n).alias("_t_" + n) for n in sums]
    aggs += [F.max(pair[n]).alias("_t_" + n) for n in last]
    aggs += [F.min(pair[n]).alias("_t_" + n) for n in following]
    blocks = rows.groupBy(*keys).agg(*aggs)
    # backward looks scan in falling order: a frame open to the right is recomputed for every row
    over = Window.partitionBy(*series_cols)
    before = over.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    after = over.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        *keys,
        *[F.coalesce(F.sum("_t_" + n).over(before), F.lit(0)).alias("_c_" + n) for n in sums],
        *[F.max("_t_" + n).over(before).alias("_c_" + n) for n in last],
        *[F.min("_t_" + n).over(after).alias("_c_" + n) for n in following])
    w = Window.partitionBy(*keys)
    upto = w.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    since = w.orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carried, keys)
    cols = [(F.coalesce(F.sum("_in_" + n).over(upto), F.lit(0)) + F.col("_c_" + n)).alias(n) for n in sums]
    cols += [F.coalesce(F.max(pair[n]).over(upto), F.col("_c_" + n)).alias(n) for n in last]
    cols += [F.coalesce(F.min(pair[n]).over(since), F.col("_c_" + n)).alias(n) for n in following]
    extra = ["_block", *["_c_" + n for n in [*sums, *last, *following]], *["_in_" + n for n in sums]]
    return joined.select("*", *cols).drop(*extra)


# ------------------------------------------------------------------ sorted scan
def _store_sorted(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]):
    """Rows range-sorted by group and order and stored with their partition number, and its running totals.

    The second table has one row per (group, partition): ``_c_<name>`` before it, ``_t_<name>`` inside it and
    ``_all_<name>`` for the whole group.
    """
    stored = df.select("*", *[c.alias("_in_" + n) for n, c in sums.items()])
    stored = settle(stored.sort(*[F.col(g) for g in group_cols], *order).withColumn("_part", F.spark_partition_id()))
    totals = stored.groupBy(*group_cols, "_part").agg(*[F.sum("_in_" + n).alias("_t_" + n) for n in sums])
    whole = Window.partitionBy(*group_cols)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("*", *[F.coalesce(F.sum("_t_" + n).over(before), F.lit(0)).alias("_c_" + n) for n in sums],
                            *[F.sum("_t_" + n).over(whole).alias("_all_" + n) for n in sums])
    return stored, offsets


def sorted_scan(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
                sums: Mapping[str, str | Column] = (), row_number: str | None = None,
                bounded: bool = False, totals: bool = False) -> DataFrame:
    """Running totals (and row numbers) of each group in any order.

    The rows are range-sorted by group and order, stored once with the partition they fell in, and
    scanned per (group, partition): a group that holds most rows spreads over many partitions.
    ``order`` must be unique within a group for a reproducible result. ``totals`` adds ``<name>_total``,
    the whole group's sum. ``bounded`` marks groups whose size is fixed by construction (24 hours,
    k levels) and uses a plain window.
    """
    sums = {n: (F.col(c) if isinstance(c, str) else c) for n, c in dict(sums).items()}
    if row_number:
        sums[row_number] = F.lit(1).cast("long")
    if bounded:
        w = Window.partitionBy(*group_cols)
        upto = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        ends = [F.sum(c).over(w).alias(n + "_total") for n, c in sums.items()] if totals else []
        return df.select("*", *[F.sum(c).over(upto).alias(n) for n, c in sums.items()], *ends)
    stored, offsets = _store_sorted(df, group_cols, order, sums)
    w = Window.partitionBy(*group_cols, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cols = [(F.coalesce(F.sum("_in_" + n).over(w), F.lit(0)) + F.col("_c_" + n)).alias(n) for n in sums]
    if totals:
        cols += [F.col("_all_" + n).alias(n + "_total") for n in sums]
    return stored.join(offsets, [*group_cols, "_part"]).select(*df.columns, *cols)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str] = (), max_rows: int | None = None,
           how: str = "inner") -> DataFrame:
    """Put group statistics beside their rows.

    Without keys the one-row statistics become scalar subqueries. With keys it is an equi-join;
    ``max_rows`` states a size fixed by construction (say 12 × 24 calendar cells) and allows a broadcast.
    """
    if not keys:
        names = stats.columns
        one = stats.select(F.struct(*names).alias("s")).scalar()
        out = df.withColumn("_stats", one)
        return out.select(*[F.col(c) for c in df.columns], *[F.col("_stats")[n].alias(n) for n in names])
    small = F.broadcast(stats) if max_rows is not None and max_rows <= 100_000 else stats
    return df.join(small, list(keys), how)


def value_counts(df: DataFrame, group_cols: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their counts: the map-side combined form used by ranks and quantiles."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*group_cols, value)
            .agg(F.count("*").alias("_n")))


def average_ranks(df: DataFrame, group_cols: Sequence[str], value: str, rank: str = "rank") -> DataFrame:
    """One row per (group, value) with its average rank (ties share the mean of their places)."""
    scanned = sorted_scan(value_counts(df, group_cols, value), group_cols, [F.col(value)], {"_cum": "_n"})
    return scanned.withColumn(rank, F.col("_cum") - (F.col("_n") - 1) / 2.0)


def quantiles(df: DataFrame, group_cols: Sequence[str], value: str, probs: Mapping[str, float],
              bounded: bool = False, finite_sample: Mapping[str, float] = ()) -> DataFrame:
    """Exact quantiles by linear interpolation, one column per entry of ``probs``.

    ``bounded`` is for groups of a size fixed by construction: the built-in exact aggregate is used.
    Otherwise distinct values with counts are range-sorted and stored, and only the few stored partitions
    that hold a wanted order statistic are scanned: no task holds a group. ``finite_sample`` entries are
    order statistics ceil((n + 1) * level), capped at n.
    """
    if bounded and not finite_sample:
        return df.groupBy(*group_cols).agg(
            *[F.percentile(value, F.lit(float(p))).alias(n) for n, p in probs.items()])
    stored, offsets = _store_sorted(value_counts(df, group_cols, value), group_cols, [F.col(value)], {"cum": F.col("_n")})
    total, v = F.col("_all_cum"), F.col(value)
    wanted = {}
    for name, p in dict(probs).items():
        at = (total - 1) * F.lit(float(p))
        wanted[name] = (F.floor(at), F.ceil(at), at - F.floor(at))
    for name, level in dict(finite_sample).items():
        k = F.least(F.ceil((total + 1) * F.lit(float(level))), total) - 1
        wanted[name] = (k, k, F.lit(0.0))

    def holds(first: Column, past: Column, k: Column) -> Column:
        return (first <= k) & (k < past)

    here = F.lit(False)
    for lo, hi, _ in wanted.values():
        for k in (lo, hi):
            here = here | holds(F.col("_c_cum"), F.col("_c_cum") + F.col("_t_cum"), k)
    w = Window.partitionBy(*group_cols, "_part").orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    rows = stored.join(offsets.filter(here), [*group_cols, "_part"])
    rows = rows.withColumn("_past", F.sum("_n").over(w) + F.col("_c_cum")).withColumn("_first", F.col("_past") - F.col("_n"))
    aggs, outs = [], []
    for name, (lo, hi, share) in wanted.items():
        aggs += [F.max(F.when(holds(F.col("_first"), F.col("_past"), k), v)).alias(f"_{side}_{name}") for side, k in (("lo", lo), ("hi", hi))]
        aggs.append(F.max(share).alias("_f_" + name))
        low = F.col("_lo_" + name)
        outs.append((low + (F.col("_hi_" + name) - low) * F.col("_f_" + name)).alias(name))
    return rows.groupBy(*group_cols).agg(*aggs).select(*group_cols, *outs)
