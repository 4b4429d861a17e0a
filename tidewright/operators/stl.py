"""Seasonal-trend decomposition by local regression, with robustness weights, for series of any length.

One pass (Cleveland et al., 1990) smooths each phase of the period, takes the low frequencies out of that, and smooths what is left to a
trend. A slot's new parts depend only on slots within ``reach`` of it, so a round of passes runs on blocks of slots with halos that wide:
one shuffle a round, no task with a long series. Robustness weights need the median remainder of a whole series, which is an exact
quantile between rounds. Where all series fit one block, a task runs all rounds of a series by the same functions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.ordering import BLOCK, quantiles, with_halo
from tidewright.session import settle

#: Local fits are made for so many pairs of slots at once, which bounds a task's memory.
_CELLS = 1 << 20


def local_fit(values: np.ndarray, weights: np.ndarray, window: int, at: np.ndarray) -> np.ndarray:
    """Tricube-weighted local lines through each row of ``values`` (series × slots), evaluated at slots ``at`` (one beyond the ends at most).

    A window holds the ``window`` nearest slots. Missing values weigh nothing. Where all weights of a window are zero, the result is the
    plain mean of its values; where it has none, NaN.
    """
    known = np.isfinite(values)
    values, weights = np.where(known, values, 0.0), np.where(known, weights, 0.0)
    m = values.shape[1]
    width = min(window, m)
    out = np.full((len(values), len(at)), np.nan)
    if not values.size:
        return out
    step = max(1, _CELLS // (width * len(values)))
    for a in range(0, len(at), step):
        x = at[a:a + step]
        slots = np.clip(x - window // 2, 0, m - width)[:, None] + np.arange(width)
        apart = (slots - x[:, None]).astype(float)
        far = np.abs(apart).max(axis=1, keepdims=True) + max(window - m, 0) // 2
        near = np.clip(1 - (np.abs(apart) / np.maximum(far, 1)) ** 3, 0, None) ** 3
        w, v = weights[:, slots] * near, values[:, slots]
        total = w.sum(axis=2)
        with np.errstate(invalid="ignore", divide="ignore"):
            level, middle = (w * v).sum(axis=2) / total, (w * apart).sum(axis=2) / total
            spread = (w * apart ** 2).sum(axis=2) / total - middle ** 2
            slope = ((w * apart * v).sum(axis=2) / total - middle * level) / spread
            fit = np.where(spread > 1e-6, level - slope * middle, level)
            count = known[:, slots].sum(axis=2)
            out[:, a:a + step] = np.where(total > 0, fit, v.sum(axis=2) / np.where(count, count, np.nan))
    return out


class _Windows:
    """Widths of the three smoothers of a period: odd numbers of slots (of periods for the seasonal one)."""

    def __init__(self, period: int, seasonal: int, trend: int | None):
        if period < 2 or seasonal < 3 or seasonal % 2 == 0 or (trend is not None and (trend < 3 or trend % 2 == 0)):
            raise ValueError("the period is 2 at least, windows are odd numbers of 3 at least")
        self.period, self.seasonal, self.low = period, seasonal, period + 1 + period % 2
        self.trend = trend or int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))) // 2 * 2 + 1
        self.reach = self.trend + self.low + period + 2 + seasonal * period

    def one_pass(self, y: np.ndarray, trend: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, p = len(y), self.period
        rows = -(-n // p)
        full = n - (rows - 1) * p  # so many phases have a value in the last, maybe partial, period

        def by_phase(x):
            return np.r_[x, np.full(rows * p - n, np.nan)].reshape(rows, p).T

        parts, w = by_phase(y - trend), by_phase(weights)
        cycle = np.full((p, rows + 2), np.nan)  # a period longer at both ends
        for phases, m in ((slice(0, full), rows), (slice(full, p), rows - 1)):
            cycle[phases, :m + 2] = local_fit(parts[phases, :m], w[phases, :m], self.seasonal, np.arange(-1, m + 1))
        cycle = cycle.T.ravel()[:n + 2 * p]
        low = cycle
        for width in (p, p, 3):
            low = np.convolve(low, np.full(width, 1 / width), "valid")
        slots = np.arange(n)
        low = local_fit(low[None], np.ones((1, n)), self.low, slots)[0]
        seasonal = cycle[p:p + n] - low
        return seasonal, local_fit((y - seasonal)[None], weights[None], self.trend, slots)[0]

    def passes(self, y, trend, weights, inner: int):
        seasonal = np.zeros(len(y))
        for _ in range(inner):
            seasonal, trend = self.one_pass(y, trend, weights)
        return seasonal, trend


def _bisquare(resid: np.ndarray) -> np.ndarray:
    apart = np.abs(resid)
    known = np.isfinite(apart)
    limit = 6 * np.median(apart[known]) if known.any() else 0.0
    if limit <= 0:
        return np.ones(len(resid))
    return np.where(known, np.clip(1 - (np.where(known, apart, 0.0) / limit) ** 2, 0, None) ** 2, 1.0)


def _decompose(rows: DataFrame, series_cols, pos, value, windows: _Windows, inner: int, outer: int, block: int) -> DataFrame:
    """``rows`` (stored) with ``trend seasonal resid robust`` added."""
    keys, names = list(series_cols), rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    new = ["trend", "seasonal", "robust"]
    schema = fields + ", trend double, seasonal double, robust double"

    def on_grid(pdf, columns):
        """Slots of the rows and each column as an array over all slots between the first and the last."""
        at = (pdf[pos] - pdf[pos].min()).to_numpy(dtype=np.int64)
        arrays = []
        for c in columns:
            x = np.full(int(at.max()) + 1, np.nan)
            x[at] = pdf[c].to_numpy(dtype=float)
            arrays.append(x)
        return at, arrays

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        at, (y,) = on_grid(pdf, [value])
        trend, weights = np.zeros(len(y)), np.ones(len(y))
        for number in range(outer + 1):
            if number:
                weights = _bisquare(y - seasonal - trend)  # noqa: F821 - set by the round before
            seasonal, trend = windows.passes(y, trend, weights, inner)
        return pdf[names].assign(trend=trend[at], seasonal=seasonal[at], robust=weights[at])

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        at, (y, trend, weights) = on_grid(pdf, [value, "trend", "robust"])
        seasonal, trend = windows.passes(y, trend, np.where(np.isfinite(weights), weights, 1.0), inner)
        out = pdf[[*names, "robust", "_home", "_block"]].assign(trend=trend[at], seasonal=seasonal[at])
        return out[out["_home"] == out["_block"]][[*names, *new]]

    spans = rows.groupBy(*keys).agg((F.max(pos) - F.min(pos) + 1).alias("span"))
    longest = spans.agg(F.max("span")).first()[0] or 0
    resid = F.col(value) - F.col("trend") - F.col("seasonal")
    if longest <= block:
        state = rows.groupBy(*keys).applyInPandas(whole, schema)
    else:
        reach = windows.reach * inner
        state = rows.withColumns({"trend": F.lit(0.0), "robust": F.lit(1.0)})
        for number in range(outer + 1):
            if number:
                rest = state.withColumns({"_off": F.abs(resid), "_id": F.to_json(F.struct(*keys))})  # never null, as keys may be
                middle = quantiles(rest, ["_id"], "_off", {"_middle": 0.5})
                u = F.col("_off") / (6 * F.col("_middle"))
                weight = F.when(F.col("_off").isNotNull() & (F.col("_middle") > 0), F.pow(F.greatest(1 - u * u, F.lit(0.0)), 2)).otherwise(1.0)
                state = rest.join(middle, "_id", "left").select(*names, "trend", weight.alias("robust"))
            halo = with_halo(state, pos, reach, reach, max(block, 3 * reach))
            state = settle(halo.groupBy(*keys, "_block").applyInPandas(piece, schema))
    tidy = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in new]
    return state.select(*names, *tidy).withColumn("resid", resid)


def _stored(df: DataFrame, series_cols, pos, value) -> DataFrame:
    v = F.col(value).cast("double")
    return settle(df.select(*series_cols, pos, F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias(value)))


def stl(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, period: int, seasonal_window: int = 7,
        trend_window: int | None = None, robust: bool = False, inner: int | None = None, outer: int | None = None,
        block: int = BLOCK) -> DataFrame:
    """Series columns, position and value with ``trend seasonal resid`` and the robustness weight ``robust`` of each slot.

    ``robust`` runs 2 passes in each of 15 more rounds, in which slots with large remainders weigh less; else 5 passes in one round.
    Positions are unique per series (or there is one series without columns) and have no gaps longer than a block; a slot without a value,
    absent or null, weighs nothing and has no remainder. Series shorter than a period have null parts. An empty table gives an empty one.
    """
    inner = inner if inner is not None else (2 if robust else 5)
    outer = outer if outer is not None else (15 if robust else 0)
    if not series_cols:
        one = df.select(F.lit(0).alias("_one"), pos, value)
        return stl(one, ["_one"], pos, value, period, seasonal_window, trend_window, robust, inner, outer, block).drop("_one")
    return _decompose(_stored(df, series_cols, pos, value), series_cols, pos, value, _Windows(period, seasonal_window, trend_window), inner, outer, block)


def multi_stl(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, periods: Sequence[int],
              seasonal_windows: Sequence[int] | None = None, iterate: int = 2, block: int = BLOCK, **how) -> DataFrame:
    """Several seasonal parts ``seasonal_<period>``, each by ``stl`` of what the other ones leave, in ``iterate`` turns; then ``trend resid``.

    Windows grow with the place of a period: 11, 15, 19, ... unless stated.
    """
    periods = sorted(periods)
    windows = list(seasonal_windows or (11 + 4 * i for i in range(len(periods))))
    inner, outer = how.pop("inner", 5), how.pop("outer", 0)
    if how:
        raise TypeError(f"unknown arguments {sorted(how)}")
    rows = _stored(df, series_cols, pos, value).withColumns({f"seasonal_{p}": F.lit(0.0) for p in periods} | {"_left": F.col(value)})
    names = rows.columns
    for turn in range(iterate if len(periods) > 1 else 1):
        for p, window in zip(periods, windows):
            rows = settle(rows.select(*names).withColumn("_left", F.col("_left") + F.col(f"seasonal_{p}")))
            rows = _decompose(rows, series_cols, pos, "_left", _Windows(p, window, None), inner, outer, block)
            rows = rows.withColumn(f"seasonal_{p}", F.col("seasonal")).withColumn("_left", F.col("_left") - F.col("seasonal"))
    return rows.withColumn("resid", F.col("_left") - F.col("trend")).drop("_left", "seasonal", "robust")
