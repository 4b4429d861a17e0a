"""The spectrum of whole series of any length, without a task that holds a series.

The transform of n slots is written as a convolution with a chirp (Bluestein), so n may be any number, and the convolution's transforms of
M = 2^b >= 2n - 1 slots are cut in four steps: a table of about sqrt(M) × sqrt(M) slots is transformed by columns, turned by twiddle factors
and transformed by rows. Blocks of ``WIDTH`` columns or rows travel between tasks, so a task holds ``WIDTH`` · sqrt(2M) numbers: 3 shuffles in all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.recursion import beside_keys
from tidewright.session import settle

WIDTH = 64


def _shape(n: int) -> tuple[int, int]:
    """Rows and columns of the table for n slots, powers of two."""
    bits = max(1, (2 * n - 2).bit_length())
    return 1 << bits // 2, 1 << (bits - bits // 2)


def _chirp(at: np.ndarray, n: int, sign: int) -> np.ndarray:
    return np.exp(sign * 1j * np.pi * (at * at % (2 * n)) / n)


def whole_spectrum(df: DataFrame, series_cols: Sequence[str], pos: str, value: str) -> DataFrame:
    """The transform of each whole series less its mean: (series, k, period, re, im, power) for k = 1 … n // 2, ``period`` in slots.

    n counts the slots from a series' first to its last position; absent slots and missing values count as the mean. The phase starts at the
    first slot. ``power`` is 2 |X|² / n, at k = n / 2 half of it. Positions are unique in a series. A single slot, like an empty table, gives no rows.
    """
    if not series_cols:
        return whole_spectrum(df.select(F.lit(0).alias("_one"), pos, value), ["_one"], pos, value).drop("_one")
    keys, width = list(series_cols), WIDTH
    v = F.col(value).cast("double")
    rows = settle(df.select(*keys, F.col(pos).cast("long").alias("_pos"), F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("_x")))
    ends = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min("_pos").alias("_p0"), (F.max("_pos") - F.min("_pos") + 1).alias("_n"), F.coalesce(F.avg("_x"), F.lit(0.0)).alias("_mean"))
    ends = settle(ends.where("_n > 1"))
    bits = F.greatest(F.length(F.bin(2 * F.col("_n") - 2)), F.lit(1))
    columns = F.pow(F.lit(2.0), F.ceil(bits / 2)).cast("long")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    slots = rows.join(ends.withColumn("_columns", columns), on=same).select(
        *keys, "_n", (F.col("_pos") - F.col("_p0")).alias("_i"), (F.coalesce("_x", "_mean") - F.col("_mean")).alias("_d"), "_columns")
    slots = slots.withColumn("_c2", F.floor(F.pmod("_i", "_columns") / width)).drop("_columns")
    # a row for each block of columns, so that one whose slots are all absent is there as well
    frames = ends.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "_n", F.lit(None).cast("long").alias("_i"), F.lit(0.0).alias("_d"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(columns / width) - 1)).alias("_c2"))
    names = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    block = ", ".join([*names, "_n long, _c1 long, _c2 long, _signal binary, _kernel binary"])

    def table(pdf):
        n = int(pdf["_n"].iloc[0])
        n1, n2 = _shape(n)
        return n, n1, n2, min(width, n1), min(width, n2)

    def blocks(pdf, records):
        return beside_keys(pd.DataFrame(records, columns=["_n", "_c1", "_c2", "_signal", "_kernel"]), pdf, keys)[[*keys, "_n", "_c1", "_c2", "_signal", "_kernel"]]

    def by_columns(pdf: pd.DataFrame) -> pd.DataFrame:
        n, n1, n2, w1, w2 = table(pdf)
        c2, total = int(pdf["_c2"].iloc[0]), n1 * n2
        here = c2 * w2 + np.arange(w2)
        known = pdf[pdf["_i"].notna()]
        i = known["_i"].to_numpy(dtype=np.int64)
        signal = np.zeros((n1, w2), dtype=complex)
        signal[i // n2, i % n2 - c2 * w2] = known["_d"].to_numpy(dtype=float) * _chirp(i, n, -1)
        at = np.arange(n1)[:, None] * n2 + here
        apart = np.minimum(at, total - at)
        kernel = np.where(apart < n, _chirp(apart, n, 1), 0)
        turn = np.exp(-2j * np.pi * (np.arange(n1)[:, None] * here) / total)
        signal, kernel = (np.fft.fft(x, axis=0) * turn for x in (signal, kernel))
        return blocks(pdf, [(n, c1, c2, signal[c1 * w1:(c1 + 1) * w1].tobytes(), kernel[c1 * w1:(c1 + 1) * w1].tobytes()) for c1 in range(n1 // w1)])

    def by_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        n, n1, n2, w1, w2 = table(pdf)
        c1, pdf = int(pdf["_c1"].iloc[0]), pdf.sort_values("_c2")
        signal, kernel = (np.fft.fft(np.hstack([np.frombuffer(b, dtype=complex).reshape(w1, w2) for b in pdf[c]]), axis=1) for c in ("_signal", "_kernel"))
        here = c1 * w1 + np.arange(w1)
        out = np.fft.ifft(signal * kernel, axis=1) * np.exp(2j * np.pi * (here[:, None] * np.arange(n2)) / (n1 * n2))
        return blocks(pdf, [(n, c1, c2, np.ascontiguousarray(out[:, c2 * w2:(c2 + 1) * w2]).tobytes(), b"") for c2 in range(n2 // w2)])

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        n, n1, n2, w1, w2 = table(pdf)
        c2, pdf = int(pdf["_c2"].iloc[0]), pdf.sort_values("_c1")
        out = np.fft.ifft(np.vstack([np.frombuffer(b, dtype=complex).reshape(w1, w2) for b in pdf["_signal"]]), axis=0)
        k = (np.arange(n1)[:, None] * n2 + c2 * w2 + np.arange(w2)).ravel()
        keep = (k >= 1) & (k <= n // 2)
        k, x = k[keep], out.ravel()[keep]
        x = x * _chirp(k, n, -1)
        res = pd.DataFrame({"k": k, "period": n / k, "re": x.real, "im": x.imag, "power": np.where(2 * k == n, 1.0, 2.0) * np.abs(x) ** 2 / n})
        return beside_keys(res, pdf, keys)[[*keys, "k", "period", "re", "im", "power"]]

    out = slots.unionByName(frames).groupBy(*keys, "_c2").applyInPandas(by_columns, block)
    out = out.groupBy(*keys, "_c1").applyInPandas(by_rows, block)
    return out.groupBy(*keys, "_c2").applyInPandas(back, ", ".join([*names, "k long, period double, re double, im double, power double"]))


def dominant_periods(spectrum: DataFrame, series_cols: Sequence[str], top: int = 5) -> DataFrame:
    """The ``top`` strongest periods of each series with ``rank`` and ``share`` of all power; ties to the longer period."""
    rows = settle(spectrum)
    order = Window.partitionBy(*series_cols).orderBy(F.desc("power"), "k")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # each task keeps its own top before the shuffle
    total = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(series_cols)]).agg(F.sum("power").alias("_all"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(series_cols)]
    return best.join(total, on=same or F.lit(True)).select(*series_cols, "rank", "k", "period", "power", (F.col("power") / F.col("_all")).alias("share"))
