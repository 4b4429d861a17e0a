"""Exact top-k search by inner product: vectors in buckets of like length, pruned by length and by coordinates, then verified.

A query q with a k-th best score of at least s finds among lengths up to l only vectors whose cosine with q is s / (|q| l) or more.
Above 1, they are left out; where it is high, the strongest coordinates of q bound those of a hit; else vectors too short for the score are cut off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import partitions_of, small_batches, tidy
from tidewright.session import settle

#: Ratio of lengths within a bucket; vectors of a block and queries of a group at most; longest vectors from which first thresholds come, at least.
RATIO, BLOCK, QUERIES, SEEDS = 1.1, 4096, 512, 2048
#: Components of a block or group, of a chunk read at once, of all vectors for first thresholds; vectors and components of a tile: all at most.
BLOCK_CELLS, CHUNK_CELLS, SEED_CELLS, TILE, TILE_CELLS = 1 << 19, 1 << 22, 1 << 22, 1 << 18, 1 << 24
#: Local cosine thresholds from which coordinates are looked at, and how many of them.
STEEP, FOCUS = 0.35, 4
#: Vectors of a tile multiplied at once, and those of them whose best score is looked at; mean hits of a query from which ties are looked at; hits sorted together.
RUN, CELL, MANY, HITS = 4096, 16, 32, 1 << 18
_EPS = 1e-9


def _scaled(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are there and finite throughout, and those as rows floor(scale · x), short ones filled up with zeros."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    widths = np.diff(column.offsets.to_numpy(zero_copy_only=False))[there].astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    of = np.repeat(np.arange(len(widths)), widths)
    good = np.ones(len(widths), bool)
    good[of[~np.isfinite(flat)]] = False
    flat, of, widths = np.floor(scale * flat[good[of]]), np.repeat(np.arange(good.sum()), widths[good]), widths[good]
    out = np.zeros((len(widths), widths.max(initial=0)))
    out[of, np.arange(len(flat)) - np.repeat(np.cumsum(widths) - widths, widths)] = flat
    there[there] = good
    return there, out


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rows) of several parts in one, rows filled up with zeros."""
    width = max(m.shape[1] for _, m in parts)
    return np.concatenate([i for i, _ in parts]), np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, m in parts])


def _chunks(batches, scale: float):
    """(ids, rows) of the batches' vectors, about ``CHUNK_CELLS`` components at a time."""
    held, cells = [], 0
    for batch in batches:
        there, m = _scaled(batch.column(1), scale)
        if not len(m):
            continue
        held.append((batch.column(0).to_numpy(zero_copy_only=False)[there], m))
        cells += m.size + len(m)
        if cells >= CHUNK_CELLS:
            yield _joined(held)
            held, cells = [], 0
    if held:
        yield _joined(held)


def _like(x: np.ndarray) -> np.ndarray:
    """Number of the geometric bucket of lengths or the like; one of its own for zero and less."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, np.clip(np.floor(np.log(x) / np.log(RATIO)), -(1 << 39), 1 << 39), -(1 << 40)).astype(np.int64)


def _cuts(buckets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of at most ``most`` places of one bucket each; buckets stand together."""
    edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
    return [(i, min(i + most, b)) for a, b in zip(edges, edges[1:]) for i in range(a, b, most)]


def _sizes(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m, m))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for whole numbers, exactly; results beyond 64 bits are cut to them."""
    width = min(a.shape[1], b.shape[0])
    a, b = a[:, :width], b[:width]
    if not a.size or not b.size:
        return np.zeros((a.shape[0], *b.shape[1:]), np.int64)
    if np.abs(a).max() * np.abs(b).max() * width < 2**53:
        return (a @ b).astype(np.int64)
    wide = np.array([[int(x) for x in r] for r in a], object) @ np.array([int(x) for x in b.ravel()], object).reshape(b.shape)
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def _as_bytes(m: np.ndarray) -> bytes:
    """Whole numbers in two or four bytes each if they fit, behind a byte that says so."""
    most = np.abs(m).max(initial=0)
    return b"h" + m.astype("<i2").tobytes() if most < 2**15 else b"i" + m.astype("<i4").tobytes() if most < 2**31 else b"d" + m.astype("<f8").tobytes()


def _matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {b"h": "<i2", b"i": "<i4", b"d": "<f8"}[raw[:1]], offset=1).astype(np.float64).reshape(n, -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, smaller ids first among equals."""
    return np.lexsort((ids, ~scores))[:k]  # unlike -x, ~x is defined for the least number too


def search_block(query: np.ndarray, query_id: int, least: float, ids: np.ndarray, rows: np.ndarray, lengths: np.ndarray, units: np.ndarray, k: int):
    """Best k of a block (lengths descending) for a query, among those that score ``least`` or more: (ids, scores)."""
    size = float(np.sqrt(query @ query))
    pick = None
    if least > 0:
        if size == 0:
            return ids[:0], np.empty(0, np.int64)
        near = least / (size * lengths[0]) if lengths[0] else np.inf
        if near > 1 + _EPS:
            return ids[:0], np.empty(0, np.int64)
        upto = int(np.searchsorted(-lengths, -(least / size) * (1 - _EPS), side="right"))
        pick = np.arange(upto)
        if near > STEEP:
            near = min(near, 1.0)
            q = query / size
            for f in np.argsort(-np.abs(q))[:FOCUS]:
                room = np.sqrt(max(0.0, (1 - near * near) * (1 - q[f] * q[f])))
                low = -1.0 if q[f] <= -near else q[f] * near - room
                high = 1.0 if q[f] >= near else q[f] * near + room
                u = units[pick, f]
                pick = pick[(u >= low - 1e-7) & (u <= high + 1e-7)]
    if pick is not None:
        ids, rows = ids[pick], rows[pick]
    scores = _exact(rows, query)
    keep = (ids != query_id) & (scores >= least)
    ids, scores = ids[keep], scores[keep]
    top = _best(ids, scores, k)
    return ids[top], scores[top]


class Tile:
    """Packed vectors laid out longest first, with the least and largest unit coordinates of each run of ``RUN`` of them."""

    def __init__(self, packed: list):
        counts = [len(ids) // 8 for ids, _ in packed]
        parts = [(ids, raw, _matrix(raw, n).shape[1], _sizes(_matrix(raw, n))) for (ids, raw), n in zip(packed, counts)]
        lengths, ids = np.concatenate([p[3] for p in parts]), np.concatenate([np.frombuffer(p[0], np.int64) for p in parts])
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.lengths = ids[order], lengths[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # a component is at most the length, and whole numbers up to 2^24 are exact in four bytes; zero rows fill up the last cell
        self.rows = np.zeros((-(-len(order) // CELL) * CELL, max(p[2] for p in parts)), np.float32 if self.lengths[0] < 2**24 else np.float64)
        at = 0
        for (_, raw, width, _), n in zip(parts, counts):
            self.rows[place[at : at + n], :width] = _matrix(raw, n)
            at += n
        self.runs = []
        for a in range(0, len(order), RUN):
            b = min(a + RUN, len(order))
            units = self.rows[a:b] / np.where(self.lengths[a:b] > 0, self.lengths[a:b], 1)[:, None]
            self.runs.append((a, b, units.min(0), units.max(0), np.sort(self.ids[a:b])))

    def search(self, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int):
        """Best k for each query among those that score ``least`` or more: ids and scores, a row per query, and how many of a row count.

        Thresholds rise as hits come in, so that few scores besides the best are looked at one by one.
        """
        n, width = len(queries), max(queries.shape[1], self.rows.shape[1])
        q = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        rows = self.rows if self.rows.shape[1] == width else np.pad(self.rows, ((0, 0), (0, width - self.rows.shape[1])))
        q_sizes, floor = _sizes(q), least.astype(np.float64).copy()
        found = (np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64))
        unit = q / np.where(q_sizes > 0, q_sizes, 1)[:, None]
        own = min(FOCUS, self.rows.shape[1])
        focus = np.argsort(-np.abs(unit[:, : self.rows.shape[1]]), axis=1)[:, :own]
        strong = np.take_along_axis(unit, focus, axis=1)
        short = q.astype(np.float32)
        room_for = {}
        for a, b, low, high, sorted_ids in self.runs:
            need = np.where(floor > 0, np.divide(floor, q_sizes, out=np.full(n, np.inf), where=q_sizes > 0), -np.inf)
            with np.errstate(divide="ignore", invalid="ignore"):
                near = np.where(floor > 0, need / self.lengths[a] if self.lengths[a] else np.inf, -np.inf)
            live = near <= 1 + _EPS
            if not live.any():
                break  # what follows is shorter still
            steep = np.flatnonzero(live & (near > STEEP))
            if len(steep):
                c, s, f = np.minimum(near[steep], 1.0)[:, None], strong[steep], focus[steep]
                room = np.sqrt(np.maximum(0.0, (1 - c * c) * (1 - s * s)))
                out = (np.where(s <= -c, -1.0, s * c - room) - 1e-7 > high[f]) | (np.where(s >= c, 1.0, s * c + room) + 1e-7 < low[f])
                live[steep[out.any(1)]] = False
            pick = np.flatnonzero(live)
            if not len(pick):
                continue
            b = a + max(1, int(np.searchsorted(-self.lengths[a:b], -need[pick].min() * (1 - _EPS), side="right")))
            most = q_sizes[pick].max() * self.lengths[a]  # bounds every partial sum of a product
            if not most < 2**52:
                some, lengths = rows[a:b].astype(np.float64), self.lengths[a:b]
                units = some / np.where(lengths > 0, lengths, 1)[:, None]
                for i in pick:
                    ids, scores = search_block(q[i], query_ids[i], floor[i], self.ids[a:b], some, lengths, units, k)
                    _merge(found, floor, np.full(len(ids), i), scores, ids, k)
                continue
            kind = np.float32 if most < 2**24 and rows.dtype == np.float32 else np.float64
            cells = -(-(b - a) // CELL)
            if kind not in room_for:
                room_for[kind] = np.empty(n * RUN, kind)
            scores = room_for[kind][: len(pick) * cells * CELL].reshape(len(pick), -1)
            asked = short if kind == np.float32 else q
            np.matmul(asked if len(pick) == n else asked[pick], rows[a : a + cells * CELL].astype(kind, copy=False).T, out=scores)
            scores[:, len(self.ids) - a :] = -np.inf
            at = np.minimum(np.searchsorted(sorted_ids, query_ids[pick]), len(sorted_ids) - 1)
            for j in np.flatnonzero(sorted_ids[at] == query_ids[pick]):
                scores[j, np.flatnonzero(self.ids[a : a + cells * CELL] == query_ids[pick[j]])] = -np.inf
            _hits(scores.reshape(len(pick), CELL, cells), pick, self.ids[a:], floor, found, k)
        return found


def _hits(scores: np.ndarray, of: np.ndarray, ids: np.ndarray, floor: np.ndarray, found: tuple, k: int) -> None:
    """Take what queries (``of``) find in a run, whose cells stand across (every n-th vector is in one), into ``found`` and raise their thresholds."""
    cells, top = scores.shape[2], scores.max(axis=1)
    least = np.maximum(floor[of], np.finfo(scores.dtype).min).astype(scores.dtype)
    hit = np.flatnonzero(top.max(axis=1) >= least)
    if not len(hit):
        return
    top, least, of = top[hit], least[hit], of[hit]
    if top.shape[1] >= k:  # k cells have a score of that or more each
        least = np.maximum(least, np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k])
    row, cell = np.nonzero(top >= least[:, None])
    scores = scores[hit[row], :, cell]
    mask = scores >= least[row, None]
    counts = np.count_nonzero(mask, axis=1)
    if counts.sum() > MANY * len(hit):  # of scores equal to a full list's last, only those of smaller ids matter
        last = np.where((found[2][of] == k) & (found[1][of, k - 1] == least), found[0][of, k - 1], np.iinfo(np.int64).max)
        theirs = ids[np.minimum(cell[:, None] + cells * np.arange(scores.shape[1]), len(ids) - 1)]
        mask &= (scores > least[row, None]) | (theirs <= last[row, None])
        counts = np.count_nonzero(mask, axis=1)
    ends = np.cumsum(counts)
    start = 0
    while start < len(row):  # no more than HITS or a cell together
        stop = max(start + 1, int(np.searchsorted(ends, HITS + (ends[start - 1] if start else 0), side="right")))
        r, c = np.divmod(np.flatnonzero(mask[start:stop]), scores.shape[1])
        r += start
        _merge(found, floor, of[row[r]], scores[r, c].astype(np.int64), ids[cell[r] + cells * c], k)
        start = stop


def _merge(found: tuple, floor: np.ndarray, of: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Take hits (query's place, score, id) into the lists of the best k; a full list's last score is its query's threshold."""
    top_ids, top_scores, have = found
    if not len(of):
        return
    touched = np.unique(of)
    r, c = np.nonzero(np.arange(k) < have[touched][:, None])
    of, scores, ids = (np.concatenate(x) for x in ((of, touched[r]), (scores, top_scores[touched[r], c]), (ids, top_ids[touched[r], c])))
    order = np.lexsort((ids, ~scores, of))
    of, scores, ids = of[order], scores[order], ids[order]
    starts = np.searchsorted(of, touched)
    counts = np.diff(np.append(starts, len(of)))
    place = np.arange(len(of)) - np.repeat(starts, counts)
    keep = place < k
    top_ids[of[keep], place[keep]], top_scores[of[keep], place[keep]] = ids[keep], scores[keep]
    have[touched] = np.minimum(counts, k)
    full = touched[have[touched] == k]
    floor[full] = np.maximum(floor[full], top_scores[full, k - 1])


def _pack(batches, scale: float):
    """Blocks of vectors of one bucket each, lengths descending."""
    for ids, m in _chunks(batches, scale):
        lengths = _sizes(m)
        order = np.argsort(-lengths, kind="stable")
        ids, m, lengths = ids[order], m[order], lengths[order]
        buckets = _like(lengths)
        cuts = _cuts(buckets, max(1, min(BLOCK, BLOCK_CELLS // max(1, m.shape[1]))))
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array([int(buckets[a]) for a, _ in cuts], pa.int64()), "n": pa.array([b - a for a, b in cuts], pa.int64()),
            "longest": pa.array([float(lengths[a]) for a, _ in cuts], pa.float64()), "width": pa.array([m.shape[1]] * len(cuts), pa.int64()),
            "ids": pa.array([ids[a:b].tobytes() for a, b in cuts], pa.binary()), "vectors": pa.array([_as_bytes(m[a:b]) for a, b in cuts], pa.binary())})


def _pack_queries(batches, scale: float, first: Tile, k: int):
    """Groups of queries that need vectors of about the same length, with the k-th best score of each among ``first``."""
    for ids, m in _chunks(batches, scale):
        least = np.full(len(ids), -np.inf)
        for a in range(0, len(ids), QUERIES):
            part = slice(a, a + QUERIES)
            _, scores, have = first.search(m[part], ids[part], least[part], k)
            least[part] = np.where(have == k, scores[:, k - 1], -np.inf)
        size = _sizes(m)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(least > 0, np.where(size > 0, least / size, np.inf), -np.inf)
        order = np.argsort(-need, kind="stable")
        ids, m, least, need = ids[order], m[order], least[order], need[order]
        cuts = _cuts(_like(need), max(1, min(QUERIES, BLOCK_CELLS // max(1, m.shape[1]))))
        yield pa.RecordBatch.from_pydict({
            "n": pa.array([b - a for a, b in cuts], pa.int64()), "need": pa.array([float(need[a:b].min()) * (1 - 1e-6) for a, b in cuts], pa.float64()),
            "ids": pa.array([ids[a:b].tobytes() for a, b in cuts], pa.binary()), "vectors": pa.array([_as_bytes(m[a:b]) for a, b in cuts], pa.binary()),
            "least": pa.array([least[a:b].tobytes() for a, b in cuts], pa.binary())})


def _found(queue: list, tile: Tile, k: int) -> pa.RecordBatch:
    ids, m = _joined([(np.frombuffer(i, np.int64), _matrix(v, len(i) // 8)) for i, v, _ in queue])
    top_ids, scores, have = tile.search(m, ids, np.concatenate([np.frombuffer(x) for _, _, x in queue]), k)
    keep = np.arange(k) < have[:, None]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, have)), pa.array(top_ids[keep]), pa.array(scores[keep])], ["query_id", "vec_id", "score"])


def _search(batches, k: int):
    """Hits of tiles: of each, its blocks come first and are kept, then its groups of queries pass by."""
    now, packed, tile, queue, rows = None, [], None, [], 0
    for batch in batches:
        for number, kind, ids, vectors, least in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if number != now:
                if queue:
                    yield _found(queue, tile, k)
                now, packed, tile, queue, rows = number, [], None, [], 0
            if kind == 0:
                packed.append((ids, vectors))
            elif packed or tile:
                if tile is None:
                    tile, packed = Tile(packed), []
                if queue and rows + len(ids) // 8 > QUERIES:
                    yield _found(queue, tile, k)
                    queue, rows = [], 0
                queue.append((ids, vectors, least))
                rows += len(ids) // 8
    if queue:
        yield _found(queue, tile, k)


def top_k(df: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """``query_id rank vec_id score``: for every row where ``queries`` holds, the k other rows of the highest inner product.

    Components become floor(scale · x); scores are exact whole numbers (cut to 64 bits), ties go to the smaller id. Every other row is a candidate.
    Vectors that are null or hold a null or a non-finite component, and rows without an id, take no part. Shorter vectors count as filled up
    with zeros. A query's own are all rows of its id; other repeated rows are candidates each; repeated queries count once.
    An empty table gives no rows.

    Each task packs the vectors it reads into blocks of a bucket. Tiles are runs of buckets cut to a bounded size; each is laid out once, in one task, and
    groups of queries pass by it, only those that its longest vector could serve. The driver gets a row per bucket and some of the longest blocks.
    """
    spark = df.sparkSession
    small_batches(spark)
    of = F.col(embedding) if dict(df.dtypes)[embedding] in ("array<float>", "array<double>") else F.col(embedding).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("id"), of.alias("v"), queries.alias("asks")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    blocks = settle(rows.select("id", "v").mapInArrow(tidy(lambda batches: _pack(batches, scale)), "bucket long, n long, longest double, width long, ids binary, vectors binary"))

    # a row per bucket: fewer than 15,000, as lengths are doubles
    buckets = sorted(blocks.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), F.max("longest").alias("longest"), F.max("width").alias("width")).collect(),
                     key=lambda b: -b["bucket"])
    if not buckets:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    starts = np.cumsum([0, *(b["n"] for b in buckets)])
    n, width = int(starts[-1]), max(1, *(b["width"] for b in buckets))

    # the longest vectors, about this many: bounded, however large the table
    wanted = max(1, min(max(SEEDS, n // 256), SEED_CELLS // width))
    upto = int(np.searchsorted(starts[1:], min(wanted, n)))
    at_hand = -(-wanted * sum(b["blocks"] for b in buckets[: upto + 1]) // int(starts[upto + 1]))
    seeds = blocks.where(F.col("bucket") >= buckets[upto]["bucket"]).select("ids", "vectors").limit(at_hand).collect()
    first = spark.sparkContext.broadcast([(bytes(r["ids"]), bytes(r["vectors"])) for r in seeds])

    finite = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    asked = rows.where("asks").where(finite).select("id", "v").dropDuplicates(["id", "v"])
    groups = settle(asked.mapInArrow(tidy(lambda batches: _pack_queries(batches, scale, Tile(first.value), k)), "n long, need double, ids binary, vectors binary, least binary"))
    n_asked = groups.agg(F.sum("n")).first()[0] or 0

    # enough tiles for the tasks at hand, but no more copies of the queries than candidates unless tiles would be too large
    most = max(1, min(TILE, TILE_CELLS // width))
    tiles = max(-(-n // most), min(-(-n // BLOCK), partitions_of(spark), max(2 * spark.sparkContext.defaultParallelism, n // max(1, n_asked))))
    share = -(-n // tiles)
    longest = np.zeros(tiles)
    for b, start in zip(buckets, starts):
        touched = slice(start // share, min(tiles, (start + b["n"]) // share + 1))
        longest[touched] = np.maximum(longest[touched], b["longest"])
    places = F.broadcast(spark.createDataFrame([(b["bucket"], int(s), b["n"]) for b, s in zip(buckets, starts)], "bucket long, start long, count long"))
    tile = F.expr(f"cast(least({tiles - 1}, floor((start + count * (pmod(xxhash64(ids), 1073741824) / 1073741824D)) / {share})) as int)")
    stored = blocks.join(places, "bucket").select(tile.alias("tile"), F.lit(0).alias("kind"), "ids", "vectors", F.lit(None).cast("binary").alias("least"))
    reached = F.filter(F.array(*[F.struct(F.lit(t).alias("tile"), F.lit(float(x)).alias("longest")) for t, x in enumerate(longest)]), lambda t: t["longest"] >= F.col("need"))
    sent = groups.select(F.explode(reached).alias("t"), "ids", "vectors", "least").select("t.tile", F.lit(1).alias("kind"), "ids", "vectors", "least")
    met = stored.unionByName(sent).repartitionById(tiles, "tile").sortWithinPartitions("tile", "kind")

    hits = met.mapInArrow(tidy(lambda batches: _search(batches, k)), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
