"""Shared pieces of the training-data operators: Arrow passes over texts and id-ordered blocks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A null id sorts before every other one.
LOWEST = -(2**63)
#: Texts handed to one call, in bytes: bounds a Python worker's memory however long single batches are.
PIECE_BYTES = 8 << 20


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python 1,000 rows and about 1 MB at a time and read them from Parquet 512 rows at a time, unless the session has numbers of its own.

    Spark's 10,000 rows are 100 MB and more of long texts. Buffers of batches double as they grow and stay with the executor, beside its heap too.
    """
    for name, usual, own in (("execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("execution.arrow.maxBytesPerBatch", "67108864b", "1m"),
                             ("parquet.columnarReaderBatchSize", "4096", "512")):
        if spark.conf.get(f"spark.sql.{name}", usual) == usual:
            spark.conf.set(f"spark.sql.{name}", own)


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes in ``column``, one row at least."""
    sizes = batch.column(column).nbytes
    if sizes <= most:
        yield batch
        return
    lengths = np.array([0 if x is None else x for x in pa.compute.binary_length(batch.column(column)).to_pylist()])
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def joined(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches put together as long as they have at most ``most`` bytes in ``column``."""
    held, total = [], 0
    for batch in batches:
        size = batch.column(column).nbytes
        if held and total + size > most:
            yield pa.concat_batches(held)
            held, total = [], 0
        held.append(batch)
        total += size
    if held:
        yield pa.concat_batches(held)


class _Worker:
    """What a Python worker keeps from task to task: the state of one operator, so that stages don't pile up in its memory."""

    key, value, used = None, None, False


def worker_state(key, build: Callable):
    """The state under ``key`` that earlier tasks of this worker left, or a new one in place of any other."""
    _Worker.used = True
    if _Worker.key != key:
        _Worker.key, _Worker.value = None, None
        _Worker.value = build()
        _Worker.key = key
    return _Worker.value


def tidy(run: Callable) -> Callable:
    """``run`` over the batches of a task, which at its end gives freed memory back to the system: workers live on for other stages."""
    def whole(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # large buffers then go back as soon as they are freed
        try:
            yield from run(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)
    return whole


def map_texts(df: DataFrame, keep: Sequence[str], text: str, make: Callable[[], Callable], adds: str, arrow: bool = False, most: int = PIECE_BYTES, join: bool = False) -> DataFrame:
    """``keep`` as it is, beside the columns ``adds`` (DDL) that ``make()(texts)`` returns as lists or arrays.

    ``make`` runs once per task; ``texts`` is a list of str or None, or with ``arrow`` the Arrow array, of about ``most`` bytes, with ``join`` from
    several batches. Only ``keep`` and ``text`` leave the scan.
    """
    small_batches(df.sparkSession)
    added = StructType.fromDDL(adds)
    schema = StructType([df.schema[c] for c in keep] + list(added))
    typed, own = to_arrow_schema(schema), [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _Worker.used = False
        fn = make()
        if not _Worker.used:
            _Worker.key, _Worker.value = None, None
        for whole in joined(batches, "__text", most) if join else batches:
            for batch in pieces(whole, "__text", most):
                made = fn(batch.column("__text") if arrow else batch.column("__text").to_pylist())
                cols = [batch.column(f"__keep{i}").cast(typed.field(i).type) for i in range(len(keep))]
                cols += [x.cast(typed.field(n).type) if isinstance(x, pa.Array) else pa.array(x, typed.field(n).type, from_pandas=False)
                         for n, x in zip(own, made, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema=typed)

    thin = df.select(*[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
    return thin.mapInArrow(tidy(run), schema)


def _edges(df: DataFrame, key: str) -> np.ndarray:
    """Ascending cuts of the long ``key`` into ranges of about as many rows each, one per shuffle partition at most."""
    n = partitions_of(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    return np.array(sorted({int(x) for x in (df.approxQuantile(key, probs, min(0.01, 0.1 / n)) if n > 1 else [])}), np.int64)


def id_ranges(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Add ``_block``, the number of the range of ``key`` that a row lies in, and say how many there are. Nothing is moved."""
    edges = _edges(df, key)

    @F.pandas_udf("int")
    def cell(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k.to_numpy(np.int64), side="right").astype(np.int32))

    return df.withColumn("_block", cell(key)), len(edges) + 1


def id_blocks_ahead(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Deal rows out by ascending ranges of the long ``key``, each range one partition, so that each range knows what follows it.

    Rows of the smallest key of a range are copied to the range before it (the first one's to the last), with ``_ahead`` 1. One shuffle;
    ranges come from quantiles of the key, so a skewed id space is no matter; what meets in a partition is streamed.
    """
    small_batches(df.sparkSession)
    ranged, _ = id_ranges(df.select(key), key)
    firsts = ranged.groupBy("_block").agg(F.min(key).alias("k")).collect()  # a row per range
    starts = np.array(sorted(r["k"] for r in firsts), dtype=np.int64)
    blocks = max(1, len(starts))

    @F.pandas_udf("array<int>")
    def cells(k: pd.Series) -> pd.Series:
        k = k.to_numpy(np.int64)
        own = np.searchsorted(starts, k, side="right") - 1
        first = starts[own] == k
        return pd.Series([[int(o), -1 - int((o - 1) % blocks)] if f else [int(o)] for o, f in zip(own, first)])

    dealt = df.withColumn("_cell", F.explode(cells(key)))
    dealt = dealt.withColumn("_ahead", (F.col("_cell") < 0).cast("int")).withColumn(
        "_block", F.when(F.col("_cell") < 0, -1 - F.col("_cell")).otherwise(F.col("_cell"))).drop("_cell")
    return dealt.repartitionById(blocks, "_block"), blocks
