"""N-gram Jaccard join: documents whose sets of word shingles are alike, found through prefixes under several token orders.

Equal sets make a class. For each order of all tokens, two sets of likeness t share a token among the first
n - ceil(t n) + 1 tokens of both. The first order puts rare tokens first: tokens of one class only fill most prefixes and can't meet
anybody, so few documents are left. The others are orders by hash, which candidates must pass too before their overlap is counted.

* sizes, digests and the tokens of a zone (those of a small hash) of each text, in one pass over texts
* classes per token of the zone, counted by ranges of tokens; tokens in one of about 2,048 documents are known beforehand, rank last and aren't shuffled
* prefixes by (classes, hash); tokens outside of the zone and frequent ones follow by hash
* classes that share prefix tokens, however indirectly, are a group; a group is one tile, or several blocks by size and hash whose pairs
  are tiles where they share a prefix token. Every tile is compared at once with overlap counts of all its pairs, in bounded memory
* only a tree of each tile's links leaves the task; components of the trees are those of all links
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewright.llm.common import map_texts, partitions_of, tidy
from tidewright.llm.components import components
from tidewright.session import settle

#: Share of all tokens, by hash, of which classes are counted. It has to exceed the share of a prefix; more of it only costs.
ZONE = 0.3
#: Documents in a block of a large group and tokens in it; a tile has two blocks at most.
BLOCK_DOCS, BLOCK_TOKENS = 256, 1 << 20
#: Seeds of the token orders besides the first.
ORDERS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Ids that a driver-side table may hold at most before a join takes its place.
SMALL_TABLE = 1_000_000

_M = np.uint64(0x9E3779B97F4A7C15)
_FLIP = np.uint64(1 << 63)
_EDGE = np.uint64(int(ZONE * 2**64))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * _M
        x ^= x >> np.uint64(32)
        x *= _M
        x ^= x >> np.uint64(29)
    return x


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words of a text; of all its words if they are fewer."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    take = min(width, n)
    s = h[: n - take + 1] + np.uint64(take)
    with np.errstate(over="ignore"):
        for k in range(1, take):
            s = s * _M
            s ^= s >> np.uint64(29)
            s += h[k: n - take + 1 + k]
    return np.unique(_mixed(s))


def digest(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def prefix_size(n, percent: int):
    """How many of n tokens, at the front of an order, a set of that likeness must share one of. Works on arrays too."""
    return n + n * percent // -100 + 1


def _longs(x: np.ndarray) -> np.ndarray:
    """uint64 as int64 in the same order."""
    return (x ^ _FLIP).view(np.int64)


def _tokens_of(binaries) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in binaries]


def profile(df: DataFrame, keep: list[str], text: str, width: int, percent: int) -> DataFrame:
    """``keep`` with ``n cls zone rest``: set size, class, zone tokens, and the next tokens where the zone is smaller than the prefix."""
    def make():
        def one(t):
            s = shingles(t, width)
            if not len(s):
                return 0, None, None, None
            z = int(np.searchsorted(s, _EDGE))
            rest = s[z: max(z, prefix_size(len(s), percent))]
            return len(s), digest(s), s[:z].tobytes(), rest.tobytes() if len(rest) else None
        return lambda texts: list(zip(*map(one, texts))) if texts else ([], [], [], [])

    return map_texts(df, keep, text, make, "n long, cls long, zone binary, rest binary")


def _frequent(rows: DataFrame, n_docs: int) -> np.ndarray:
    """Zone tokens in about one of 2,048 documents or more, sorted. Their number is bounded by that; which ones they are only affects speed."""
    def run(batches):
        held, docs, total = [], 0, 0

        def flush():
            t, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= max(2, docs // 1024)
            return pa.RecordBatch.from_arrays([pa.array(_longs(t[keep])), pa.array(c[keep])], ["token", "c"])

        for b in batches:
            for t in _tokens_of(x for x in b.column(0).to_pylist() if x):
                held.append(t)
                docs, total = docs + 1, total + len(t)
                if total > 2_000_000:
                    yield flush()
                    held, docs, total = [], 0, 0
        if held:
            yield flush()

    found = rows.select("zone").mapInArrow(tidy(run), "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    found = found.where(F.col("c") >= max(64, n_docs // 2048)).orderBy(F.desc("c"), "token").limit(SMALL_TABLE).select("token")
    return np.sort(np.array([r[0] for r in found.collect()], np.int64).view(np.uint64) ^ _FLIP)


def _without(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Mask of the tokens that aren't among the frequent ones."""
    if not len(frequent):
        return np.ones(len(tokens), bool)
    at = np.searchsorted(frequent, tokens)
    return frequent[np.minimum(at, len(frequent) - 1)] != tokens


def _shared_tokens(rows: DataFrame, frequent) -> DataFrame:
    """(``cls``, ``token``, ``df``) for zone tokens, other than frequent ones, of two classes or more."""
    n = partitions_of(rows.sparkSession)
    cuts = np.array([int(ZONE * 2**64 * i / n) for i in range(1, n)], np.uint64)

    def deal(batches):
        held, total = [], 0

        def flush():
            t = np.concatenate([x for x, _ in held])
            c = np.repeat(np.array([y for _, y in held], np.int64), [len(x) for x, _ in held])
            keep = _without(t, frequent.value)
            t, c = t[keep], c[keep]
            order = np.argsort(t, kind="stable")
            t, c = t[order], c[order]
            ends = [0, *np.searchsorted(t, cuts, side="right").tolist(), len(t)]
            some = [(i, a, b) for i, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in some], pa.int32()), pa.array([t[a:b].tobytes() for _, a, b in some], pa.binary()),
                                               pa.array([c[a:b].tobytes() for _, a, b in some], pa.binary())], ["cell", "tokens", "classes"])

        for b in batches:
            for z, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if z:
                    held.append((np.frombuffer(z, np.uint64), k))
                    total += len(z) // 8
                    if total > 1_000_000:
                        yield flush()
                        held, total = [], 0
        if held:
            yield flush()

    def count(batches):
        t, c = [], []
        for b in batches:
            t += _tokens_of(b.column(1).to_pylist())
            c += [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
        if not t:
            return
        t, c = np.concatenate(t), np.concatenate(c)
        order = np.lexsort((c, t))
        t, c = t[order], c[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])]
        t, c = t[new], c[new]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        df = np.diff(np.r_[first, len(t)])
        df = np.repeat(df, df)
        keep = df > 1
        t, c, df = _longs(t[keep]), c[keep], df[keep]
        for a in range(0, len(t), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[a: a + (1 << 16)]) for x in (c, t, df)], ["cls", "token", "df"])

    dealt = rows.select("zone", "cls").mapInArrow(tidy(deal), "cell int, tokens binary, classes binary").repartitionById(n, "cell")
    return dealt.mapInArrow(tidy(count), "cls long, token long, df long")


def _tails(rows: DataFrame, frequent, percent: int) -> DataFrame:
    """``n zn`` of each class (set size, zone tokens but frequent ones) with ``tail``: what of its prefix lies beyond those."""
    def run(batches):
        for b in batches:
            n, zn, tail = b.column(0).to_pylist(), [], []
            for k, z, r in zip(n, b.column(2).to_pylist(), b.column(3).to_pylist()):
                z = np.frombuffer(z or b"", np.uint64)
                rare = _without(z, frequent.value)
                zn.append(int(rare.sum()))
                spare = int(prefix_size(k, percent)) - zn[-1]
                tail.append(_longs(np.concatenate([z[~rare], np.frombuffer(r or b"", np.uint64)])[:spare]).tolist() if spare > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(zn, pa.int64()), pa.array(tail, pa.list_(pa.int64()))],
                                             ["cls", "n", "zn", "tail"])

    return rows.select("n", "cls", "zone", "rest").mapInArrow(tidy(run), "cls long, n long, zn long, tail array<long>")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common tokens of all pairs of sets."""
    m = len(sets)
    t = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(t, kind="stable")
    t, owner = t[order], owner[order]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    df = np.diff(np.r_[first, len(t)])
    out = np.zeros(m * m, np.int64)
    for d in np.unique(df):
        at = first[df == d]
        if 1 < d <= 16:
            own = owner[at[:, None] + np.arange(d)]
            i, j = np.triu_indices(d, 1)
            out += np.bincount((own[:, i] * m + own[:, j]).ravel(), minlength=m * m)
    out = out.reshape(m, m)
    out += out.T
    dense = first[df > 16]
    lens = df[df > 16]
    for a in range(0, len(dense), 4096):
        x = np.zeros((m, min(4096, len(dense) - a)), np.float32)
        for c, (f, d) in enumerate(zip(dense[a: a + 4096].tolist(), lens[a: a + 4096].tolist())):
            x[owner[f: f + d], c] = 1
        out += np.rint(x @ x.T).astype(np.int64)
    return out


def linked(sets: list[np.ndarray], side: np.ndarray, within: bool, percent: int) -> np.ndarray:
    """Which sets of a tile are alike, as a symmetric matrix: those of one block, or (not ``within``) of different ones."""
    n = np.array([len(s) for s in sets])
    low, high = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
    may = (100 * low >= percent * high) & ((side[:, None] != side) | within)
    np.fill_diagonal(may, False)
    for seed in ORDERS:
        if not may.any():
            return may
        front = []
        for s in sets:
            k = prefix_size(len(s), percent)
            front.append(s if k >= len(s) else s[np.argpartition(_mixed(s ^ np.uint64(seed)), k - 1)[:k]])
        may &= _overlaps(front) > 0
    if not may.any():
        return may
    both = _overlaps(sets)
    return may & (100 * both >= percent * (n[:, None] + n - both))


def _compare(batches, percent: int):
    """Rows of tiles (``tile side within cls copies tokens``, sorted by tile) to (``cls``, ``root``, ``links``)."""
    def solve(rows):
        side = np.array([r[0] for r in rows])
        ids, copies = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        alike = linked(_tokens_of(r[4] for r in rows), side, bool(rows[0][1]), percent)
        with_any = np.flatnonzero(alike.any(1))
        if not len(with_any):
            return None
        label = np.arange(len(rows))
        while True:
            new = np.minimum(label, np.where(alike, label, len(rows)).min(1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        return pa.RecordBatch.from_arrays([pa.array(ids[with_any]), pa.array(ids[label[with_any]]), pa.array((alike @ copies)[with_any])], ["cls", "root", "links"])

    held, tile = [], None
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(6))):
            if row[0] != tile and held:
                out = solve(held)
                if out is not None:
                    yield out
                held = []
            tile = row[0]
            held.append(row[1:])
    if held:
        out = solve(held)
        if out is not None:
            yield out


def _tiles(index: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (``tile``, ``side``, ``within``, ``cls``): which classes are compared together. ``classes`` has ``cls grp n``."""
    sizes = classes.groupBy("grp").agg(F.count("*").alias("gc"), F.sum("n").alias("gn"))
    rows = classes.join(sizes, "grp")
    alone = (F.col("gc") <= 2 * BLOCK_DOCS) & (F.col("gn") <= 2 * BLOCK_TOKENS)
    small = rows.where(alone).select(F.concat_ws("/", "grp").alias("tile"), F.lit(0).alias("side"), F.lit(1).alias("within"), "cls")
    # likenesses of 0.8 bind sizes to a factor of 1.25: one band of sizes meets itself and the next ones
    large = rows.where(~alone).withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25))))
    bands = large.groupBy("grp", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("parts"))
    large = settle(large.join(bands, ["grp", "band"]).select("cls", "grp", F.concat_ws(
        ".", F.lpad("band", 4, "0"), F.lpad(F.expr("pmod(xxhash64(cls), parts)"), 9, "0")).alias("block"), "band"))
    seen = index.join(large, "cls").select("token", "grp", "block", "band").distinct()
    pairs = seen.alias("x").join(seen.alias("y"), "token").where("x.block <= y.block and abs(x.band - y.band) <= 1").select(
        F.col("x.grp").alias("grp"), F.col("x.block").alias("one"), F.col("y.block").alias("two")).distinct()
    tiles = settle(pairs.withColumn("tile", F.concat_ws("/", "grp", "one", "two")).withColumn("within", (F.col("one") == F.col("two")).cast("int")))
    ends = tiles.select("grp", F.col("one").alias("block"), "tile", "within", F.lit(0).alias("side")).unionByName(
        tiles.where("within = 0").select("grp", F.col("two").alias("block"), "tile", "within", F.lit(1).alias("side")))
    return small.unionByName(large.join(ends, ["grp", "block"]).select("tile", "side", "within", "cls"))


def _tokens_by_digest(df: DataFrame, text: str, wanted: DataFrame, n_wanted: int, width: int) -> DataFrame:
    """``cls tokens`` of the ``wanted`` classes, found by the digests of all texts in one pass: at most one row per class and task."""
    few = df.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in wanted.collect()], np.int64))) if n_wanted <= SMALL_TABLE else None

    def make():
        seen = set()

        def one(t):
            s = shingles(t, width)
            own = digest(s) if len(s) else None
            if own is None or own in seen or few is not None and few.value[np.searchsorted(few.value[:-1], own)] != own:
                return None, None
            seen.add(own)
            return own, s.tobytes()
        return lambda values: list(zip(*map(one, values))) if values else ([], [])

    found = map_texts(df, [], text, make, "cls long, tokens binary").where("cls is not null")
    return found if few is not None else found.join(wanted, "cls", "left_semi")


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5,
                       mark: str | None = None) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_shingles`` (set size), ``component_id`` (smallest id reachable by links) and
    ``n_links`` (documents linked with it directly, copies included).

    Two documents link when 100 · common >= ``percent`` · all of their sets of ``width``-word shingles. Sets are compared by 64-bit hashes,
    of tokens and of whole sets (equal sets). Null, empty and white texts: 0 shingles, no links, a component of their own. Null ids:
    linked like others, but never name a component unless all its ids are null. Repeated rows and ids: each row counts as a document.
    Empty table: no rows. ``percent`` must be above 70, as prefixes have to lie within the zone. Other columns of ``df`` take no part.

    ``mark`` names a long column that tells apart the texts under one id. The result then has it too, as ``mark``, and ``first``: whether the
    row is the one of its component with the smallest id (null last) and then mark, or a repeat of that. Rows without words are first.
    """
    if percent < 71:
        raise ValueError("the zone of counted tokens holds prefixes for likenesses above 0.70 only")
    spark = df.sparkSession
    thin = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *([F.col(mark).alias("mark")] if mark else []))
    rows = settle(profile(thin, [c for c in thin.columns if c != "text"], "text", width, percent))
    some = rows.where("n > 0")
    frequent = spark.sparkContext.broadcast(_frequent(some, rows.count()))
    sized = settle(_tails(some, frequent, percent).groupBy("cls").agg(
        F.max("n").alias("n"), F.max("zn").alias("zn"), F.count("*").alias("copies"), F.max("tail").alias("tail")))

    own = Window.partitionBy("cls")
    shared = _shared_tokens(some, frequent).join(sized.select("cls", "n", "zn"), "cls").withColumns({
        "at": F.row_number().over(own.orderBy("df", "token")), "met": F.count("*").over(own)})
    width_of_prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    index = shared.where(F.col("zn") - F.col("met") + F.col("at") <= width_of_prefix).select("token", "cls")
    index = settle(index.unionByName(sized.where("tail is not null").select(F.explode("tail").alias("token"), "cls")))
    lists = index.groupBy("token").agg(F.count("*").alias("m"), F.min("cls").alias("lead")).where("m > 1")
    index = settle(index.join(lists, "token").select("token", "cls", "lead"))
    groups = components(index.select(F.col("cls").alias("a"), F.col("lead").alias("b")))
    classes = settle(index.select("cls").distinct().join(groups.withColumnRenamed("node", "cls"), "cls", "left").join(sized, "cls").select(
        "cls", F.coalesce("root", "cls").alias("grp"), "n", "copies"))

    # tokens of the classes left, from the text of one document each: one whose id stands on no other row, if there is one
    alone = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c"), F.min("cls").alias("cls")).where("c = 1 and cls is not null")
    chosen = settle(classes.select("cls").join(alone.groupBy("cls").agg(F.min(F.col("doc_id").cast("long")).alias("_key")), "cls", "left"))
    n_chosen, n_named = chosen.agg(F.count("*"), F.count("_key")).first()
    named = chosen.where("_key is not null")
    texts = df.select(F.col(doc_id).cast("long").alias("_key"), F.col(text).alias("text"))
    texts = texts.join(F.broadcast(named) if n_named <= SMALL_TABLE else named, "_key").select("cls", "text")

    def make():
        def fn(values):
            sets = [shingles(t, width) for t in values]
            return [digest(s) for s in sets], [s.tobytes() for s in sets]
        return fn

    tokens = map_texts(texts, ["cls"], "text", make, "own long, tokens binary").where("own = cls").drop("own")
    if n_named < n_chosen:
        tokens = tokens.unionByName(_tokens_by_digest(df, text, chosen.where("_key is null").select("cls"), n_chosen - n_named, width))
    tokens = settle(tokens)
    if tokens.count() > n_chosen:  # copies met in several tasks
        tokens = settle(tokens.dropDuplicates(["cls"]))
    tiles = _tiles(index, classes).join(classes.select("cls", "copies"), "cls").join(tokens, "cls")
    tiles = tiles.select("tile", "side", "within", "cls", "copies", "tokens").repartition("tile").sortWithinPartitions("tile")
    found = settle(tiles.mapInArrow(tidy(lambda batches: _compare(batches, percent)), "cls long, root long, links long"))

    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark") if mark else F.lit(None)
    ids = some.groupBy("cls").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.min(name).alias("lead"))
    ids = settle(ids.join(roots, "cls", "left").join(links, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    lows = ids.groupBy("root").agg(F.min("low").alias("component_id"), F.min("lead").alias("chosen"))
    ids = ids.drop("lead").join(lows, "root").select("cls", "component_id", "chosen", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(ids, "cls", "left")
    more = [F.col("mark"), F.coalesce(name == F.col("chosen"), F.lit(True)).alias("first")] if mark else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"), *more)
