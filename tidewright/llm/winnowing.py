"""Document fingerprints by winnowing: rolling k-gram hashes, the minimum of each window (the rightmost of equals), with positions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import LOWEST, id_blocks_ahead, tidy

#: Code points in a gram and grams in a window: any common run of GRAM + WINDOW - 1 = 47 code points is noticed.
GRAM, WINDOW = 16, 32
#: Code points worked on at once; pieces overlap, so the cut changes nothing.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_HIGH = np.uint64(0xFF51AFD7ED558CCD)


def _powers(base: int) -> np.ndarray:
    out = np.empty(PIECE + GRAM + WINDOW, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(len(out) - 1, base, np.uint64), out=out[1:])
    return out


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams: differences of prefix sums of code · base^i, brought back to one power (rolling hash modulo 2^64)."""
    with np.errstate(over="ignore"):
        sums = np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _UP[: len(codes)], dtype=np.uint64)
        ends = sums[k - 1:].copy()
        ends[1:] -= sums[: len(sums) - k]
        h = ends * _DOWN[: len(ends)]
        h ^= h >> np.uint64(33)
        h *= _HIGH
        return (h >> np.uint64(32)).astype(np.uint32)


def _picked(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost minimum of each window, ascending, each once."""
    n = len(h)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(h[::-1]))])
    # hash above, place below and reversed: one minimum finds the smallest hash at its rightmost place
    key = (h.astype(np.uint64) << np.uint64(32)) | np.arange(n - 1, -1, -1, dtype=np.uint64)
    span, low = 1, key
    while span * 2 <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < window:
        low = np.minimum(low[: n - window + 1], low[window - span: n - span + 1])
    changed = np.flatnonzero(low[1:] != low[:-1]) + 1
    low = low[np.concatenate(([0], changed))]
    return (n - 1 - (low & np.uint64(0xFFFFFFFF)).astype(np.int64))


def winnow(text: str, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text, positions in code points and ascending. A text shorter than k is one gram; empty has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    k = min(k, len(codes))
    hashes, places, n_grams = [], [], len(codes) - k + 1
    step = PIECE - k - window
    for at in range(0, max(1, n_grams - window + 1), step):
        h = gram_hashes(codes[at: at + step + window - 1 + k - 1], k)
        p = _picked(h, window)
        hashes.append(h[p])
        places.append(p + at)
    if len(places) == 1:
        return hashes[0], places[0]
    places, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], places


def as_string(hashes: np.ndarray, places: np.ndarray) -> str:
    """``hash@position`` in hex, by position."""
    return " ".join([f"{h:08x}@{p:x}" for h, p in zip(hashes.tolist(), places.tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common ones among the distinct hashes of two fingerprints; 1 for two empty ones. ``a`` and ``b`` are sorted and distinct."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, after: str) -> str:
    """The last half of a text's code points replaced by the first as many of the text after it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each whole text, of its edited text (see ``edited``; the next one by id, after the last the first) and likenesses.

    Columns: ``doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next``. Null text: empty, with an empty
    fingerprint. Null ids come first; rows with one id follow each other by text, and repeats are rows like others. One row is its own next one.
    Empty table: no rows. Texts are shuffled once, to ranges of ids; each range is streamed with two texts in memory.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(LOWEST)))
    dealt, _ = id_blocks_ahead(rows, "_key")
    dealt = dealt.sortWithinPartitions("_ahead", "_key", "text").select("doc_id", "text", "_ahead")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        last, out, size = None, [], 0

        def one(me, after):
            (i, t, h, p, s), (t2, s2) = me, after
            e = edited(t, t2)
            eh, ep = winnow(e)
            return (i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_string(h, p), as_string(eh, ep),
                    likeness(s, np.unique(eh)), likeness(s, s2))

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            for i, t, ahead in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                t = t.as_py()
                if ahead and last is None:
                    continue
                h, p = winnow(t)
                s = np.unique(h)
                if last is not None:
                    out.append(one(last, (t, s)))
                    size += len(t)
                last = None if ahead else (i, t, h, p, s)
                if len(out) >= 512 or size > 4 << 20:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return dealt.mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                 "near_edited double, near_next double")
