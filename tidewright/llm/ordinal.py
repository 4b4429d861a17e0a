"""Quality classifier: ordinal cumulative-link regression on graded texts, with weights over hashed text features shared by all thresholds."""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import map_texts, small_batches, tidy, worker_state

#: Hash cells, and what is fitted at most: labelled rows (the bound of the sample), rounds.
CELLS, SAMPLE, ROUNDS = 1 << 15, 8000, 200
#: Words whose cells a worker keeps.
CACHE = 100_000
_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_EDGE = b".,;:!?\"'()[]{}<>*$%&#|-_/\\"


def _cell(kind: bytes, value: bytes) -> int:
    return zlib.crc32(kind + value) % CELLS


class Features:
    """Sparse vectors of texts: square roots of the shares of words, of word beginnings and of shapes (letters, case, marks), and how much a text repeats itself."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int, int]] = {}

    def _cells(self, word: bytes) -> tuple[int, int, int]:
        stem = word.lower().strip(_EDGE)
        out = _cell(b"w", stem), _cell(b"b", stem[:4]), _cell(b"s", _RUNS.sub(rb"\1", word.translate(_SHAPE)))
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[word] = out
        return out

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """(cells, values), or None for a text without words."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        n = len(words)
        if not n:
            return None
        counts, known = Counter(words), self.known
        cells = np.array([known.get(w) or self._cells(w) for w in counts]).ravel()
        shares = np.bincount(cells, weights=np.repeat(np.fromiter(counts.values(), float, len(counts)), 3) / n, minlength=CELLS)
        lines = text.split("\n")
        size = min(12, n.bit_length())
        extra = ((b"adjacent", sum(map(operator.eq, words, words[1:])) / n), (b"lines", 1 - len(set(lines)) / len(lines)),
                 (b"repeats%d" % size, 1 - len(counts) / n), (b"size%d" % size, 0.25))
        at = np.flatnonzero(shares)
        more = [(_cell(b"t", k), v) for k, v in extra if v]
        return (np.concatenate([at, [i for i, _ in more]]).astype(np.int64), np.concatenate([np.sqrt(shares[at]), [v for _, v in more]]).astype(np.float32))


@dataclass(frozen=True)
class OrdinalModel:
    """Grades 0 .. K-1: P(grade <= k) = logistic(thresholds[k] - weights · x), thresholds ascending."""

    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, x: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """Of each grade; a text without words has the lowest grade."""
        if x is None:
            return np.eye(len(self.thresholds) + 1)[0]
        upto = 1 / (1 + np.exp(np.clip(float(self.weights[x[0]] @ x[1]) - self.thresholds, -500, 500)))
        return np.diff(np.concatenate(([0.0], upto, [1.0])))


def fit_rows(vectors: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, rounds: int = ROUNDS, penalty: float = 2e-5) -> OrdinalModel:
    """Penalised likelihood by Adam over all rows at once. One row of each grade without features is added, so no grade is ever empty."""
    none = (np.empty(0, np.int64), np.empty(0, np.float32))
    vectors = list(vectors) + [none] * n_grades
    y = np.concatenate([np.asarray(grades, np.int64), np.arange(n_grades)])
    at, val = (np.concatenate([v[i] for v in vectors]) for i in (0, 1))
    row = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
    share = np.cumsum(np.bincount(y, minlength=n_grades))[:-1] / len(y)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(CELLS), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, cuts = p[:CELLS], np.cumsum(np.concatenate([p[CELLS: CELLS + 1], np.exp(p[CELLS + 1:])]))
        f = np.bincount(row, weights=w[at] * val, minlength=len(y))
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        below, above = 1 / (1 + np.exp(np.clip(f - edge[y], -500, 500))), 1 / (1 + np.exp(np.clip(f - edge[y + 1], -500, 500)))
        prob = np.maximum(above - below, 1e-12)
        slope_low, slope_high = below * (1 - below) / prob, above * (1 - above) / prob
        g = np.zeros_like(p)
        g[:CELLS] = np.bincount(at, weights=val * (slope_high - slope_low)[row], minlength=CELLS) / len(y) + penalty * w
        cut = np.bincount(y + 1, weights=-slope_high, minlength=n_grades + 1)[1:n_grades] + np.bincount(y, weights=slope_low, minlength=n_grades + 1)[1:n_grades]
        upward = np.cumsum(cut[::-1])[::-1] / len(y)
        g[CELLS], g[CELLS + 1:] = upward[0], upward[1:] * np.exp(p[CELLS + 1:])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        p = p - 0.5 * (1 - t / (rounds + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    return OrdinalModel(p[:CELLS].astype(np.float64), np.cumsum(np.concatenate([p[CELLS: CELLS + 1], np.exp(p[CELLS + 1:])])))


def fit(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", n_grades: int = 3,
        sample: int = SAMPLE, seed: int = 11) -> OrdinalModel | None:
    """Fit on at most ``sample`` of the graded documents, the first by a hash of their id. ``ratings`` has ``doc_id`` and ``grade``.

    Rows with a null id, a null grade or one out of range aren't used; of several grades of a document the lowest is. None if no row is left.
    Of several texts of a document one is used, that of the smallest hash; texts without words aren't. The sample's features, a row per
    document and so ``sample`` rows at most, meet in one task, which fits and returns the weights.
    """
    rated = ratings.where(F.col(doc_id).isNotNull() & F.col(grade).between(0, n_grades - 1)).groupBy(F.col(doc_id).alias("_id")).agg(
        F.min(grade).cast("int").alias("_grade"))
    known = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_mark"), F.col(text).alias("_text"))
    chosen = rated.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(sample)
    rows = known.join(F.broadcast(chosen), "_id")  # as many rows as stand under ``sample`` ids

    def make():
        own = worker_state("features", Features)
        def fn(texts):
            got = [own(t) for t in texts]
            return ([g and g[0].astype("<u2").tobytes() for g in got], [g and g[1].tobytes() for g in got])
        return fn

    def solve(batches):
        rows = sorted(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3))))  # reruns sum alike
        if rows:
            vectors = [(np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(val, np.float32)) for _, at, val in rows]
            m = fit_rows(vectors, np.array([r[0] for r in rows]), n_grades)
            yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), pa.array([m.thresholds.tobytes()])], ["weights", "thresholds"])

    made = map_texts(rows, ["_id", "_grade", "_mark"], "_text", make, "cells binary, vals binary").where("cells is not null")
    single = made.groupBy("_id", "_grade").agg(F.min(F.struct("_mark", "cells", "vals")).alias("x"))
    one = single.select("_grade", "x.cells", "x.vals").repartition(1)
    got = one.mapInArrow(tidy(solve), "weights binary, thresholds binary").collect()
    return OrdinalModel(np.frombuffer(got[0][0]), np.frombuffer(got[0][1])) if got else None


def quality_grades(labels: DataFrame) -> DataFrame:
    """Grades from the two marks of ``labels``: 0 toxic, 1 of poor quality, 2 good. A row without a mark for quality has none, unless it is toxic."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def score(df: DataFrame, model: OrdinalModel | None, keep: list[str], text: str = "text", tail: int = 2, least: float = 0.5) -> DataFrame:
    """``keep`` with ``expected_grade``, ``tail_probability`` (of grade ``tail`` or better) and ``accepted`` (that is ``least`` or more).

    Texts without words (null, empty, white) have the lowest grade and are not accepted. Without a model every text with words is of the highest grade.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own, m = worker_state("features", Features), shared.value
        def fn(texts):
            ps = [_probabilities(m, own(t), tail) for t in texts]
            tails = [float(p[tail:].sum()) for p in ps]
            return [float(p @ np.arange(len(p))) for p in ps], tails, [x >= least for x in tails]
        return fn

    return map_texts(df, keep, text, make, "expected_grade double, tail_probability double, accepted boolean")


def _probabilities(model, x, tail):
    if model is None:
        return np.eye(tail + 1)[0 if x is None else -1]
    return model.probabilities(x)


def accepted(spark, model: OrdinalModel | None, text: str = "text", tail: int = 2, least: float = 0.5) -> Column:
    """The decision of ``score`` as a column, for filtering rows as they are."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def decide(texts: pd.Series) -> pd.Series:
        own = worker_state("features", Features)
        return pd.Series([bool(_probabilities(shared.value, own(t), tail)[tail:].sum() >= least) for t in texts], dtype=bool)

    return decide(F.col(text))
