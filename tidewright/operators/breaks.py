"""Exact change points of the mean: a fixed count by dynamic programming in cells, or any count by optimal partitioning with a penalty.

The cost of a segment is its squared error around its mean, taken from running totals. ``pos`` orders a series; rows without a value are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.ordering import attach, sorted_scan
from tidewright.session import settle

#: Slots in a block, and blocks of earlier slots that one task compares with a block.
BLOCK, SPAN = 2048, 32
#: Change points of a series beyond which a penalised search is refused: the penalty then says nothing.
MOST = 1_000_000


def _named(out: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    return out.withColumnsRenamed({f"_key{n}": c for n, c in enumerate(series_cols)})


def _totals(df: DataFrame, series_cols: Sequence[str], pos: str, value: str) -> DataFrame:
    """(_key0, ..., pos, i, v, s, q): place from 1, the value less its series' mean, and running totals of that and of its square."""
    keys = [f"_key{n}" for n in range(len(series_cols))]
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *[F.col(c).alias(k) for k, c in zip(keys, series_cols)], F.col(pos).alias("pos"), F.col(value).cast("double").alias("v"))
    rows = attach(rows, rows.groupBy(*keys).agg(F.avg("v").alias("_m")), keys).withColumn("v", F.col("v") - F.col("_m"))
    return settle(sorted_scan(rows.select(*keys, "pos", "v"), keys, [F.col("pos")], sums={"s": "v", "q": F.col("v") * F.col("v")}, row_number="i"))


def fixed_breaks(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, n_breaks: int, min_size: int = 2) -> DataFrame:
    """The ``n_breaks`` change points with the least squared error in all: (series, number, break_pos, cost), ``cost`` of the whole.

    Segments have ``min_size`` rows at least; a series too short for that has no row. ``break_pos`` is the first slot of the right-hand segment.
    The best cost of the first t rows in k segments needs that of every shorter stretch in k - 1: one round of cells (block of ends, span of blocks of starts),
    all independent, then a minimum. So a round is spread over all tasks even for one long series, and no task holds more than SPAN + 1 blocks.
    """
    keys = [f"_key{n}" for n in range(len(series_cols))]
    rows = _totals(df, series_cols, pos, value)
    packed = F.array_sort(F.collect_list(F.struct("i", "s", "q")))  # BLOCK rows at most
    blocks = rows.withColumn("block", F.expr(f"(i - 1) div {BLOCK}")).groupBy(*keys, "block").agg(packed.alias("r"))
    blocks = settle(blocks.select(*keys, "block", F.col("r.i").alias("i"), F.col("r.s").alias("s"), F.col("r.q").alias("q")))
    ends = settle(blocks.groupBy(*keys).agg(F.max("block").alias("last"), F.max(F.element_at("i", -1)).alias("n")).filter(F.col("n") >= (n_breaks + 1) * min_size))
    blocks = blocks.join(ends.select(*keys, "last"), keys) if keys else blocks.join(ends.select(F.col("last").alias("_l")), blocks["block"] <= F.col("_l")).withColumnRenamed("_l", "last")
    lead = "".join(f"{k} {df.schema[c].dataType.simpleString()}, " for k, c in zip(keys, series_cols))

    def first(batches):
        for b in batches:
            b["f"] = [np.where(i >= min_size, q - s * s / i, np.inf) for i, s, q in zip(b["i"], b["s"], b["q"])]
            yield b

    def cell(pdf):
        goal = pdf[pdf["goal"]].iloc[0]
        start = pdf[~pdf["goal"]]
        i0, s0, q0, f0 = (np.concatenate([np.asarray(x, dtype=float) for x in start[c]]) for c in ("i", "s", "q", "f"))
        best, at = np.full(len(goal["i"]), np.inf), np.zeros(len(goal["i"]), dtype=np.int64)
        for n, (i, s, q) in enumerate(zip(goal["i"], goal["s"], goal["q"])):
            ok = i0 <= i - min_size
            if ok.any():
                size, apart = i - i0[ok], s - s0[ok]
                cost = f0[ok] + (q - q0[ok]) - apart * apart / size
                k = int(np.argmin(cost))
                best[n], at[n] = cost[k], int(i0[ok][k])
        return pd.DataFrame({**{c: [goal[c]] for c in keys}, "block": [goal["block"]], "f": [best], "at": [at]})

    def least(pdf):
        f, at = np.array(pdf["f"].tolist()), np.array(pdf["at"].tolist())
        k = np.argmin(f, axis=0)
        pick = np.arange(f.shape[1])
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, "block": [pdf["block"].iloc[0]], "f": [f[k, pick]], "at": [at[k, pick]]})

    own = [*keys, "block"]
    state = blocks.mapInPandas(first, lead + "block long, i array<long>, s array<double>, q array<double>, last long, f array<double>")
    stages = []
    for k in range(1, n_breaks + 1):
        state = settle(state)
        goals = blocks.filter("block = last") if k == n_breaks else blocks  # the last round only needs the end
        first_goal = F.col("last") if k == n_breaks else F.col("block")
        starts = state.withColumn("to", F.explode(F.sequence(first_goal, F.col("last")))).withColumn("span", F.expr(f"block div {SPAN}")).withColumn("goal", F.lit(False))
        spans = goals.withColumn("span", F.explode(F.expr(f"sequence(0L, block div {SPAN})"))).withColumn("to", F.col("block")).withColumn("goal", F.lit(True))
        cells = starts.unionByName(spans.withColumn("f", F.array().cast("array<double>"))).groupBy(*keys, "to", "span")
        found = cells.applyInPandas(cell, lead + "block long, f array<double>, at array<long>").groupBy(*own).applyInPandas(least, lead + "block long, f array<double>, at array<long>")
        found = settle(found)
        stages.append(found)
        state = blocks.join(found.select(*own, "f"), own)
    cost = F.element_at("f", -1).alias("cost")
    ahead = ends.join(stages[-1].select(*keys, F.col("block").alias("last"), cost), [*keys, "last"]).select(*keys, F.col("n").alias("end"), "cost")
    out = None
    for k in range(n_breaks, 0, -1):
        table = stages[k - 1].select(*keys, F.col("block").alias("_b"), "at")
        ahead = ahead.withColumn("_b", F.expr(f"(end - 1) div {BLOCK}")).join(table, [*keys, "_b"])
        ahead = settle(ahead.select(*keys, F.expr(f"element_at(at, cast(end - _b * {BLOCK} as int))").alias("end"), "cost"))
        part = ahead.filter("end > 0").select(*keys, F.lit(k).alias("number"), (F.col("end") + 1).alias("i"), "cost")
        out = part if out is None else out.unionByName(part)
    return _named(out.join(rows.select(*keys, "i", F.col("pos").alias("break_pos")), [*keys, "i"]).select(*keys, "number", "break_pos", "cost"), series_cols)


class _Partition:
    """Optimal partitioning of one series, fed row by row; what can never be a best last change again is dropped."""

    def __init__(self, penalty: float, min_size: int):
        self.penalty, self.min_size = penalty, min_size
        self.i, self.s, self.q = 0, 0.0, 0.0
        self.open = np.array([[0.0, 0.0, 0.0, -penalty, np.inf]])  # i, s, q, best cost, when it goes
        self.ways: list = [None]  # last change of the best partition up to each open start, and those before it
        self.best, self.way = -penalty, None

    def add(self, pos, v: float) -> None:
        if self.i:  # the row before may be the end of a segment
            if self.best < np.inf:
                self.open = np.vstack([self.open, [self.i, self.s, self.q, self.best, np.inf]]) if self.i >= self.min_size else self.open
                if self.i >= self.min_size:
                    self.ways.append((pos, self.way, 1 if self.way is None else self.way[2] + 1))
        self.i, self.s, self.q = self.i + 1, self.s + v, self.q + v * v
        stay = self.open[:, 4] > self.i
        if not stay.all():
            self.open, self.ways = self.open[stay], [w for w, keep in zip(self.ways, stay) if keep]
        size = self.i - self.open[:, 0]
        apart = self.s - self.open[:, 1]
        bare = self.open[:, 3] + (self.q - self.open[:, 2]) - apart * apart / size
        able = size >= self.min_size
        if not able.any():
            self.best, self.way = np.inf, None
            return
        k = int(np.argmin(np.where(able, bare, np.inf)))
        self.best, self.way = float(bare[k] + self.penalty), self.ways[k]
        # a start that is worse than ending here is beaten by a change here, as soon as that may end a segment
        worse = able & (bare >= self.best) & np.isinf(self.open[:, 4])
        self.open[worse, 4] = self.i + self.min_size

    def breaks(self) -> list:
        out, way = [], self.way
        while way is not None:
            out.append(way[0])
            way = way[1]
        return out[::-1]


def penalised_breaks(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, penalty: float | None = None, factor: float = 3.0, min_size: int = 2) -> DataFrame:
    """The change points that minimise squared error plus a penalty each, as many as pay: (series, number, break_pos, cost, penalty).

    ``penalty`` is that of a change, or ``factor`` times the variance of the series. A series without a change has no row.
    Each best cost needs the one before, so a series is read once in order, by one task, which keeps the starts that can still win and not the series: rows stream
    through, and the number of starts depends on how far apart changes are.
    """
    keys = [f"_key{n}" for n in range(len(series_cols))]
    rows = _totals(df, series_cols, pos, value)
    level = F.lit(float(penalty)) if penalty is not None else F.lit(float(factor)) * F.var_pop("v")
    rows = attach(rows, rows.groupBy(*keys).agg(level.alias("beta")), keys).select(*keys, "pos", "v", "beta")
    rows = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, "pos")
    names = [*keys, "number", "break_pos", "cost", "penalty"]

    def run(batches):
        current, search = None, None

        def ended():
            found = search.breaks()
            if len(found) > MOST:
                raise ValueError("more change points than a penalty should leave")
            return pd.DataFrame([(*current, n + 1, p, search.best, search.penalty) for n, p in enumerate(found)], columns=names)

        for b in batches:
            owners = list(zip(*[b[c] for c in keys])) if keys else [()] * len(b)
            for own, p, v, beta in zip(owners, b["pos"].tolist(), b["v"].tolist(), b["beta"].tolist()):
                if search is None or own != current:
                    if search is not None:
                        yield ended()
                    current, search = own, _Partition(beta, min_size)
                search.add(p, v)
        if search is not None:
            yield ended()

    lead = "".join(f"{k} {df.schema[c].dataType.simpleString()}, " for k, c in zip(keys, series_cols))
    return _named(rows.mapInPandas(run, f"{lead}number int, break_pos {df.schema[pos].dataType.simpleString()}, cost double, penalty double"), series_cols)
