"""Sequential recursions over series of any length, cut into blocks that are composed afterwards.

A recursion ``s[t] = A s[t-1] + b u[t]`` is affine, so a block of slots acts on its starting state as
``s_end = A^L s_start + c``. Three passes follow: each block finds its ``c`` from a zero start, the
short list of blocks of each series is composed in order, and each block is replayed from its true
start. Only the list of blocks (one row for ``block`` slots) is ever handled series by series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.ordering import attach
from tidewright.session import settle

BLOCK = 4096


def _in_blocks(df: DataFrame, pos: str, block: int | None) -> DataFrame:
    """Stored rows with their ``_block``; blocks grow with the square root of the span, so that neither a block
    nor the list of blocks of one series ever becomes large."""
    rows = settle(df)
    if block is None:
        first, last = rows.agg(F.min(pos), F.max(pos)).first()
        block = max(BLOCK, math.isqrt(int((last or 0) - (first or 0))))
    return rows.withColumn("_block", F.floor(F.col(pos) / block).cast("long"))


def beside_keys(out: pd.DataFrame, group: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
    """Repeat the key values of a group beside its result rows."""
    for c in keys:
        out[c] = pd.Series([group[c].iloc[0]] * len(out), index=out.index, dtype=object)
    return out


def _runs(u: np.ndarray, phi: float, start: float) -> np.ndarray:
    out = np.empty(len(u))
    s = start
    for i, v in enumerate(u):
        s = phi * s + v
        out[i] = s
    return out


def affine_filter(df: DataFrame, series_cols: Sequence[str], pos: str, inputs: dict[str, str],
                  phi: float, start: dict[str, str] | None = None, block: int | None = None) -> DataFrame:
    """Add ``out[t] = phi * out[t-1] + input[t]`` for each ``out: input`` pair.

    ``start`` names columns (constant in a series) holding the state before the first slot; zero otherwise.
    Inputs must be present on consecutive slots.
    """
    start = start or {}
    keys = [*series_cols, "_block"]
    rows = _in_blocks(df, pos, block)
    last = F.max(pos).alias("_end")
    per = rows.groupBy(*keys).agg(last, F.count("*").alias("_len"),
                                  *[F.max(start[o]).alias("_s_" + o) if o in start else F.lit(0.0).alias("_s_" + o)
                                    for o in inputs])
    # the end of a block is at most `block` slots away, so the powers stay within double range (underflow is zero)
    weighted = rows.join(per.select(*keys, "_end"), keys).groupBy(*keys).agg(
        *[F.sum(F.col(i) * F.pow(F.lit(float(phi)), F.col("_end") - F.col(pos))).alias("_c_" + o) for o, i in inputs.items()])
    blocks = per.join(weighted, keys)

    outs = list(inputs)
    names = blocks.schema
    fields = [f"`{c}` {names[c].dataType.simpleString()}" for c in keys] + [f"`_b_{o}` double" for o in outs]

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        res = pdf[keys].copy()
        decay = float(phi) ** pdf["_len"].to_numpy(dtype=float)
        for o in outs:
            s = float(pdf["_s_" + o].iloc[0])
            begin = np.empty(len(pdf))
            for k, (d, c) in enumerate(zip(decay, pdf["_c_" + o].to_numpy(), strict=True)):
                begin[k] = s
                s = d * s + c
            res["_b_" + o] = begin
        return res

    starts = blocks.groupBy(*series_cols).applyInPandas(compose, ", ".join(fields))
    joined = rows.join(starts, keys)
    schema = joined.schema
    out_fields = [f"`{c}` {schema[c].dataType.simpleString()}" for c in df.columns] + [f"`{o}` double" for o in outs]

    kept = list(df.columns)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        res = pdf[kept].copy()
        for o, i in inputs.items():
            res[o] = _runs(pdf[i].to_numpy(dtype=float), phi, float(pdf["_b_" + o].iloc[0]))
        return res

    return joined.groupBy(*keys).applyInPandas(replay, ", ".join(out_fields))


def score_grid(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, params: Sequence[dict],
               system: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]],
               start: DataFrame, start_col: str, block: int | None = None) -> DataFrame:
    """Sum of squared one-step errors of a linear state-space recursion, for every parameter set.

    ``system(p)`` gives ``A, b, h`` of ``s[t] = A s[t-1] + b y[t]`` with forecast ``h · s[t-1]``.
    ``start`` holds one row per series with the first state as an array in ``start_col``.
    Returns (series, param, sse, n, state): ``state`` is the one after the last slot.
    """
    keys = [*series_cols, "_block"]
    rows = _in_blocks(df.select(*series_cols, pos, value), pos, block)
    systems = [system(p) for p in params]
    schema = rows.schema
    key_fields = [f"`{c}` {schema[c].dataType.simpleString()}" for c in keys]

    def effect(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(pos)[value].to_numpy(dtype=float)
        out = []
        for k, (a, b, _) in enumerate(systems):
            s = np.zeros(len(b))
            for v in y:
                s = a @ s + b * v
            out.append((k, s.tolist(), len(y)))
        res = pd.DataFrame(out, columns=["param", "_c", "_len"])
        res = beside_keys(res, pdf, keys)
        return res[[*keys, "param", "_c", "_len"]]

    effects = rows.groupBy(*keys).applyInPandas(
        effect, ", ".join([*key_fields, "param int", "_c array<double>", "_len long"]))
    seeded = attach(effects, start.select(*series_cols, start_col), series_cols)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        a = systems[int(pdf["param"].iloc[0])][0]
        s = np.asarray(pdf[start_col].iloc[0], dtype=float)
        begins = []
        for c, n in zip(pdf["_c"], pdf["_len"], strict=True):
            begins.append(s.tolist())
            s = np.linalg.matrix_power(a, int(n)) @ s + np.asarray(c, dtype=float)
        res = pdf[[*keys, "param"]].copy()
        res["_s"] = begins
        return res

    begins = seeded.groupBy(*series_cols, "param").applyInPandas(
        compose, ", ".join([*key_fields, "param int", "_s array<double>"]))
    gathered = begins.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("param", "_s"))).alias("_starts"))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        y, begin = pdf[value].to_numpy(dtype=float), dict(pdf["_starts"].iloc[0])
        out = []
        for k, (a, b, h) in enumerate(systems):
            s = np.asarray(begin[k], dtype=float)
            sse = 0.0
            for v in y:
                sse += (v - h @ s) ** 2
                s = a @ s + b * v
            out.append((k, sse, len(y), s.tolist()))
        res = pd.DataFrame(out, columns=["param", "sse", "n", "state"])
        res = beside_keys(res, pdf, keys)
        return res[[*keys, "param", "sse", "n", "state"]]

    scored = rows.join(gathered, keys).groupBy(*keys).applyInPandas(
        replay, ", ".join([*key_fields, "param int", "sse double", "n long", "state array<double>"]))
    return scored.groupBy(*series_cols, "param").agg(
        F.sum("sse").alias("sse"), F.sum("n").alias("n"), F.max_by("state", "_block").alias("state"))


def scalar_grid(df: DataFrame, series_cols: Sequence[str], pos: str, cols: Sequence[str], decay: np.ndarray,
                inputs: Callable[[pd.DataFrame], np.ndarray], loss: Callable[[pd.DataFrame, np.ndarray], np.ndarray],
                start: DataFrame, start_col: str, block: int | None = None) -> DataFrame:
    """Total loss of a scalar recursion ``s[t] = decay[p] * s[t-1] + u[t, p]`` for every parameter set p.

    ``inputs(rows)`` gives the (slots × parameter sets) array u; ``loss(rows, before)`` the loss per slot
    given the state before it. Returns (series, param, loss, n, state).
    """
    keys = [*series_cols, "_block"]
    decay = np.asarray(decay, dtype=float)
    rows = _in_blocks(df.select(*series_cols, pos, *cols), pos, block)
    schema = rows.schema
    key_fields = [f"`{c}` {schema[c].dataType.simpleString()}" for c in keys]

    def effect(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        s = np.zeros(len(decay))
        for row in inputs(pdf):
            s = decay * s + row
        return beside_keys(pd.DataFrame({"_c": [s.tolist()], "_len": [len(pdf)]}), pdf, keys)[[*keys, "_c", "_len"]]

    effects = rows.groupBy(*keys).applyInPandas(effect, ", ".join([*key_fields, "_c array<double>", "_len long"]))
    seeded = attach(effects, start.select(*series_cols, start_col), series_cols)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        s = np.full(len(decay), float(pdf[start_col].iloc[0]))
        begins = []
        for c, n in zip(pdf["_c"], pdf["_len"], strict=True):
            begins.append(s.tolist())
            s = decay ** int(n) * s + np.asarray(c, dtype=float)
        res = pdf[keys].copy()
        res["_s"] = begins
        return res

    begins = seeded.groupBy(*series_cols).applyInPandas(compose, ", ".join([*key_fields, "_s array<double>"]))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        s = np.asarray(pdf["_s"].iloc[0], dtype=float)
        before = np.empty((len(pdf), len(decay)))
        for i, row in enumerate(inputs(pdf)):
            before[i] = s
            s = decay * s + row
        total = loss(pdf, before).sum(axis=0)
        res = pd.DataFrame({"param": np.arange(len(decay)), "loss": total, "n": len(pdf), "state": s})
        return beside_keys(res, pdf, keys)[[*keys, "param", "loss", "n", "state"]]

    scored = rows.join(begins, keys).groupBy(*keys).applyInPandas(
        replay, ", ".join([*key_fields, "param int", "loss double", "n long", "state double"]))
    return scored.groupBy(*series_cols, "param").agg(
        F.sum("loss").alias("loss"), F.sum("n").alias("n"), F.max_by("state", "_block").alias("state"))
