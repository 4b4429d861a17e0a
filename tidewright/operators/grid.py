"""Regular grids: complete spines, missing slots, fills, interpolation, runs and resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.gridtime import position, slot_start
from tidewright.operators.ordering import BLOCK, attach, lag_of, look_around, running


def spine(df: DataFrame, series_cols: Sequence[str], pos: str, block: int = BLOCK) -> DataFrame:
    """Every slot between the first and last one of each series.

    Slots are produced block by block after a shuffle of the (tiny) block list, so no single row
    carries the whole range of a long series.
    """
    ends = df.groupBy(*series_cols).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    blocks = ends.select(*series_cols, "_lo", "_hi", F.explode(F.sequence(
        F.floor(F.col("_lo") / block).cast("long"), F.floor(F.col("_hi") / block).cast("long"))).alias("_b"))
    blocks = blocks.repartition(*series_cols, "_b")
    return blocks.select(*series_cols, F.explode(F.sequence(
        F.greatest("_lo", F.col("_b") * block),
        F.least("_hi", F.col("_b") * block + (block - 1)))).alias(pos))


def complete(df: DataFrame, series_cols: Sequence[str], pos: str) -> DataFrame:
    """The rows of ``df`` on a complete grid; absent slots carry nulls."""
    return spine(df, series_cols, pos).join(df, [*series_cols, pos], "left")


def missing_slots(df: DataFrame, series_cols: Sequence[str], pos: str) -> DataFrame:
    """Slots of the complete grid that have no row."""
    return spine(df, series_cols, pos).join(df.select(*series_cols, pos), [*series_cols, pos], "left_anti")


def fill(df: DataFrame, series_cols: Sequence[str], pos: str, col: str, out: str, how: str = "forward") -> DataFrame:
    """Forward fill, backward fill, or ``both`` (forward, then backward for a leading gap)."""
    last = {"_prev": col} if how in ("forward", "both") else {}
    nxt = {"_next": col} if how in ("backward", "both") else {}
    rows = running(df, series_cols, pos, last=last, following=nxt)
    parts = ([F.col("_prev.value")] if last else []) + ([F.col("_next.value")] if nxt else [])
    return rows.withColumn(out, F.coalesce(*parts)).drop("_prev", "_next")


def interpolate(df: DataFrame, series_cols: Sequence[str], pos: str, col: str, out: str,
                fill_leading: bool = False) -> DataFrame:
    """Linear in time between known values; a trailing gap keeps the last value.

    A leading gap stays missing unless ``fill_leading`` asks for the first known value.
    """
    rows = running(df, series_cols, pos, last={"_prev": col}, following={"_next": col})
    p, n, at = F.col("_prev"), F.col("_next"), F.col(pos)
    share = (at - p["pos"]) / (n["pos"] - p["pos"])
    value = (F.when(F.col(col).isNotNull(), F.col(col))
             .when(p.isNull(), n["value"] if fill_leading else F.lit(None))
             .when(n.isNull(), p["value"])
             .otherwise(p["value"] + (n["value"] - p["value"]) * share))
    return rows.withColumn(out, value.cast("double")).drop("_prev", "_next")


def mark_runs(df: DataFrame, series_cols: Sequence[str], pos: str, condition: Column) -> DataFrame:
    """Beside each row where ``condition`` holds: the start, end and length of its run of slots.

    Starts and ends are found with one-slot looks and carried to the rows, so a run of any length
    is never gathered into one group.
    """
    rows = df.withColumn("_on", F.when(condition, 1).otherwise(0))
    rows = look_around(rows, series_cols, pos, {"_was": lag_of("_on", 1), "_will": lag_of("_on", -1)})
    on = F.col("_on") == 1
    rows = (rows.withColumn("_first", F.when(on & (F.coalesce("_was", F.lit(0)) == 0), F.col(pos)))
            .withColumn("_final", F.when(on & (F.coalesce("_will", F.lit(0)) == 0), F.col(pos))))
    rows = running(rows, series_cols, pos, last={"_s": "_first"}, following={"_e": "_final"})
    return (rows.withColumn("run_start", F.when(on, F.col("_s.value")))
            .withColumn("run_end", F.when(on, F.col("_e.value")))
            .withColumn("run_length", F.col("run_end") - F.col("run_start") + 1)
            .drop("_on", "_was", "_will", "_first", "_final", "_s", "_e"))


def run_table(df: DataFrame, series_cols: Sequence[str], pos: str, condition: Column) -> DataFrame:
    """One row per run of ``condition``: start slot, end slot, length."""
    return (mark_runs(df, series_cols, pos, condition).filter(F.col("run_start") == F.col(pos))
            .select(*series_cols, "run_start", "run_end", "run_length"))


def resample(df: DataFrame, series_cols: Sequence[str], ts: str, freq: str, aggs: Sequence[Column],
             keep_empty: bool = False) -> DataFrame:
    """Aggregate to a coarser grid; ``keep_empty`` also returns slots that have no rows."""
    out = (df.withColumn("_slot", position(F.col(ts), freq)).groupBy(*series_cols, "_slot").agg(*aggs))
    if keep_empty:
        out = complete(out, series_cols, "_slot")
    return out.withColumn("ts", slot_start(F.col("_slot"), freq)).drop("_slot")


def hygiene(df: DataFrame, series_cols: Sequence[str], pos: str) -> DataFrame:
    """One row per series: rows, distinct slots, duplicate rows, expected length and missing slots."""
    per_slot = df.groupBy(*series_cols, pos).agg(F.count("*").alias("_k"))
    return per_slot.groupBy(*series_cols).agg(
        F.sum("_k").alias("n_rows"), F.count("*").alias("n_slots"),
        F.sum(F.col("_k") - 1).alias("n_duplicates"),
        (F.max(pos) - F.min(pos) + 1).alias("n_expected"),
        (F.max(pos) - F.min(pos) + 1 - F.count("*")).alias("n_missing"))


def future_slots(df: DataFrame, series_cols: Sequence[str], pos: str, horizon: int) -> DataFrame:
    """The ``horizon`` slots that follow each series, with ``step`` 1 … horizon."""
    ends = df.groupBy(*series_cols).agg(F.max(pos).alias("_end"))
    steps = ends.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.withColumn(pos, F.col("_end") + F.col("step")).drop("_end")


def rebuild_level(df: DataFrame, series_cols: Sequence[str], pos: str, change: str, last_level: DataFrame,
                  level: str, out: str) -> DataFrame:
    """Levels from changes: the last known ``level`` of each series plus the running total of changes."""
    rows = running(df, series_cols, pos, sums={"_cum": change})
    return attach(rows, last_level, series_cols).withColumn(out, F.col(level) + F.col("_cum")).drop("_cum")
