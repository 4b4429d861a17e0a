import math
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewright.llm import norm_search
from tidewright.llm.norm_search import Tile, _as_bytes, _exact, _search, search_block, top_k


def by_hand(rows, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {(i, tuple(v)) for i, v in ok if i % 50 == 0}
    out = []
    for i, q in asked:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def test_random_vectors_of_all_lengths(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1500):
        v = rng.normal(size=12) * 10 ** rng.uniform(-2, 1) + (i % 3 == 0) * 2.0
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(2000 + i, rows[50][1]) for i in range(40)] + [(3000, [0.0] * 12), (3050, [-1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect())) == by_hand(rows)


def test_pruning_loses_nothing():
    rng = np.random.default_rng(7)
    m = np.floor(256 * rng.normal(size=(800, 8)) * np.r_[5, np.ones(7)])
    m = m[np.argsort(-np.einsum("ij,ij->i", m, m))]
    lengths, ids = np.sqrt(np.einsum("ij,ij->i", m, m)), rng.permutation(800)
    for q in m[::40]:
        scores = (m @ q).astype(np.int64)
        for least in (-np.inf, 0.0, np.sort(scores)[-20], scores.max(), scores.max() + 1, np.sqrt(q @ q) * lengths[0] * 0.9):
            got_ids, got = search_block(q, -1, least, ids, m, lengths, m / lengths[:, None], 5)
            want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if s >= least)[:5]
            assert [(-s, i) for s, i in zip(got.tolist(), got_ids.tolist())] == want


def test_odd_vectors(spark):
    big = 1e13
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (250, []), (1, [big, big]), (2, [1.0]),
            (3, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (300, [0.0, 0.0]), (4, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as size", "3 as rank", "4 as bucket")
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect())) == by_hand(rows)
    assert top_k(df.where("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k(df.where("vec_id = 300"), F.col("vec_id") % 50 == 0).count() == 0


NARROW = """
import sys
from pyspark.sql import SparkSession, functions as F
from tidewright.llm.norm_search import top_k
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "2g")
         .config("spark.driver.maxResultSize", "8m").config("spark.sql.files.maxPartitionBytes", "1m").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
rows = spark.read.parquet(sys.argv[1])
assert rows.rdd.getNumPartitions() >= 40
for r in top_k(rows, F.col("vec_id") % 9000 == 0, k=3).orderBy("query_id", "rank").collect():
    print("HIT", *r)
"""


def test_driver_gets_a_part_of_the_longest_vectors_whatever_the_number_of_tasks(tmp_path):
    """Before, each task sent its 2,048 longest vectors to the driver, here 40 times 1.2 MB."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(40 * 2100, 64)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    (tmp_path / "in").mkdir()
    for i in range(40):
        part = m[i * 2100 : (i + 1) * 2100]
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, 64, dtype=np.int32)), pa.array(part.ravel()))
        pq.write_table(pa.table({"vec_id": np.arange(i * 2100, (i + 1) * 2100), "embedding": vectors}), tmp_path / "in" / f"{i}.parquet")
    root = str(Path(norm_search.__file__).resolve().parents[2])
    run = subprocess.run([sys.executable, "-c", NARROW, str(tmp_path / "in"), str(tmp_path / "kept")], capture_output=True, text=True, timeout=300,
                         env={k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"PYTHONPATH": root})
    assert run.returncode == 0, run.stderr[-2000:]
    whole, want = np.floor(256 * m.astype(np.float64)), []
    for q in range(0, len(m), 9000):
        scores = whole @ whole[q]
        scores[q] = -np.inf
        want += [(q, n + 1, int(j), int(scores[j])) for n, j in enumerate(np.lexsort((np.arange(len(m)), -scores))[:3])]
    assert [tuple(map(int, x.split()[1:])) for x in run.stdout.splitlines() if x.startswith("HIT")] == want


@pytest.mark.parametrize("kind", ["lengths", "ties", "copies", "large", "zeros"])
def test_tile_finds_what_comparing_all_finds(kind, monkeypatch):
    rng = np.random.default_rng(3)
    for name, x in (("RUN", 64), ("CELL", 4), ("MANY", 2), ("HITS", 50)):
        monkeypatch.setattr(norm_search, name, x)
    m = np.floor(256 * rng.normal(size=(700, 6)) * (10 ** rng.uniform(-2, 12 if kind == "large" else 1, (700, 1)) if kind in ("lengths", "large") else 1))
    m = {"ties": np.floor(m / 256), "copies": m[rng.integers(0, 9, 700)], "zeros": np.where(rng.random((700, 1)) < 0.5, 0, m)}.get(kind, m)
    ids, picked = rng.integers(0, 500, 700), rng.integers(0, 700, 40)
    tile, full = Tile([(ids[a : a + 90].tobytes(), _as_bytes(m[a : a + 90])) for a in range(0, 700, 90)]), _exact(m[picked], m.T)
    for least_rank in (None, 6, 1):
        least = np.array([-np.inf if least_rank is None else float(np.sort(s[ids != i])[-least_rank]) for s, i in zip(full, ids[picked])])
        got_ids, got, have = tile.search(m[picked], ids[picked], least, 5)
        for j, (s, i) in enumerate(zip(full, ids[picked])):
            want = sorted((-int(x), int(y)) for x, y in zip(s, ids) if y != i and x >= least[j])[:5]
            assert [(-x, y) for x, y in zip(got[j, : have[j]].tolist(), got_ids[j, : have[j]].tolist())] == want


def test_tiles_of_a_task_stay_apart():
    m = np.array([[3.0, 1.0], [1.0, 2.0], [2.0, 2.0]])
    block, ask = (np.array([1, 2, 3]).tobytes(), _as_bytes(m)), (np.array([1]).tobytes(), _as_bytes(m[:1]))
    rows = [(0, 0, *block, None), (0, 1, *ask, np.array([-np.inf]).tobytes()), (1, 1, *ask, np.array([-np.inf]).tobytes()), (2, 0, *block, None), (2, 1, *ask, np.array([6.0]).tobytes())]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 2])], list("abcde")) for a in (0, 2, 4)]
    assert [b.to_pylist() for b in _search(batches, 2)] == [[{"query_id": 1, "vec_id": 3, "score": 8}, {"query_id": 1, "vec_id": 2, "score": 5}], [{"query_id": 1, "vec_id": 3, "score": 8}]]


def test_one_id_in_many_rows_and_vectors_of_other_types(spark):
    rows = [(7, [float(i % 13), float(i % 7) - 3.0]) for i in range(5000)] + [(50, [1.0, 1.0]), (100, [2.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(3)
    want = by_hand(rows)
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect())) == want
    whole = df.selectExpr("vec_id", "transform(embedding, x -> cast(x as int)) as embedding")
    assert sorted(map(tuple, top_k(whole, F.col("vec_id") % 50 == 0).collect())) == want
