"""Merkle manifest of a dataset: a tree of digests over the rows of each source and one over the sources, with a proof for every row.

One level of all trees is one aggregate: a node's children are spread into as many slot columns as a node has children, by conditional
aggregates; the digest of the columns together is the node, and the columns without a child's own are its siblings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import partitions_of
from tidewright.session import settle

#: Children of a node.
FANOUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def row_digest(values: Sequence[Column]) -> Column:
    """SHA-256 (lowercase hex) of values, each as its UTF-8 byte count, a colon and itself, or ``-`` if null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to along ``path``: at each level the digest of what stands left of it, itself and what stands right of it."""
    return F.aggregate(path, leaf, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of a path's sibling digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _placed(rows: DataFrame, tree: str, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows with ``pos`` (from 0, by ``order`` within ``tree``) and ``size`` of their tree, and the largest size.

    A range sort deals rows out, so a tree with a third of all rows lies in many tasks; each task's places come from where its
    rows begin, and a row per tree and task says what stands before.
    """
    keys = [F.col(tree), *[F.col(c).asc_nulls_first() for c in order]]
    rows = settle(rows.repartitionByRange(partitions_of(rows.sparkSession), *keys).sortWithinPartitions(*keys).withColumn(
        "at", F.monotonically_increasing_id())).withColumn("task", F.shiftright("at", 33))
    own = Window.partitionBy(tree)
    parts = rows.groupBy(tree, "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = settle(parts.withColumn("before", F.sum("n").over(own.orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
                   .withColumn("size", F.sum("n").over(own)).drop("n"))
    most = parts.agg(F.max("size")).first()[0] or 0
    return rows.join(parts, [tree, "task"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "task", "first", "before"), most


def _grown(nodes: DataFrame, most: int, carry: Sequence[str], fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all trees, from the lowest, and their roots (``tree``, ``root``).

    ``nodes`` has ``tree``, ``pos``, ``size``, ``digest`` and, in the lowest level only, ``carry``. A level has a row per parent with its
    children's columns as arrays, one entry for each slot; it is as wide as the fanout, so no row depends on how large a tree is.
    """
    roots, levels = nodes.where("size = 1").select("tree", F.col("digest").alias("root")), []
    while most > 1:
        cols = ["digest", *carry]
        pivot = [F.expr(f"max(case when pos % {fanout} = {i} then {c} end) as {c}_{i}") for c in cols for i in range(fanout)]
        wide = nodes.where("size > 1").groupBy("tree", F.expr(f"pos div {fanout} as parent")).agg(F.max("size").alias("size"), *pivot)
        level = settle(wide.selectExpr("tree", "parent", "size", *[f"array({', '.join(f'{c}_{i}' for i in range(fanout))}) as {c}" for c in cols]))
        levels.append(level)
        nodes = level.select("tree", F.col("parent").alias("pos"), F.expr(f"(size + {fanout - 1}) div {fanout}").alias("size"), F.sha2(F.concat_ws("", "digest"), 256).alias("digest"))
        roots = roots.unionByName(nodes.where("size = 1").select("tree", F.col("digest").alias("root")))
        carry, most = (), -(-most // fanout)
    return levels, roots


def _paths(levels: list[DataFrame], tops: DataFrame, nodes: DataFrame, carry: Sequence[str], fanout: int) -> DataFrame:
    """Every lowest node with its path (``left`` and ``right`` siblings by level). ``tops`` has a row per tree: ``tree``, ``path`` above it, and more that is handed down."""
    down = [c for c in tops.columns if c != "tree"]
    above, lowest = None, nodes.where("size = 1").join(tops, "tree").select("tree", "digest", *carry, *down)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        rows = level.where(f"size <= {fanout}").join(tops, "tree")
        if above is not None:
            inner = level.where(f"size > {fanout}").join(above, (level["tree"] == above["up"]) & (level["parent"] == above["pos"]))
            rows = rows.unionByName(inner.select(*rows.columns))
        own = list(carry) if k == 0 else []
        step = F.struct(F.expr("concat_ws('', slice(digest, 1, slot))").alias("left"), F.expr(f"concat_ws('', slice(digest, slot + 2, {fanout}))").alias("right"))
        rows = rows.withColumn("slot", F.explode(F.expr(f"sequence(0, cast(least({fanout}, size - parent * {fanout}) as int) - 1)")))
        rows = rows.withColumn("path", F.concat(F.array(step), "path")).withColumn("pos", F.col("parent") * fanout + F.col("slot"))
        if k == 0:
            return lowest.unionByName(rows.select("tree", *[F.element_at(c, F.col("slot") + 1).alias(c) for c in ["digest", *own]], *down))
        above = rows.select(F.col("tree").alias("up"), "pos", *down)
    return lowest


def manifest(df: DataFrame, fields: Sequence[str], doc_id: str = "doc_id", group: str = "source", changed: Mapping[str, Column] | None = None,
             fanout: int = FANOUT) -> DataFrame:
    """``doc_id leaf claimed subroot root path`` for each row of ``df``.

    ``leaf`` is the digest of ``fields``; ``claimed`` that of the fields as ``changed`` says (the same, if nothing is). Leaves of a ``group``
    ascend by id (null first, then by digest); every ``fanout`` of them in a row become their digest, until one is left, the ``subroot``.
    Subroots, by group (null first, bytewise), give ``root`` likewise. ``path`` has the siblings of each level, for ``fold``.

    Null group: a group of its own. Null ids, repeated ids and repeated rows: each row is a leaf. A group of one row: its leaf is the
    subroot. No rows: none. Null and empty fields differ. Only the named columns are read, whatever else there is.
    Texts are hashed where they are read; what moves is digests. A level has a sixteenth of the rows of the one below, in groups of 16.
    """
    now = {f: F.col(f) for f in fields} | dict(changed or {})
    rows = df.select(F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("-")).alias("tree"), F.col(doc_id).alias("id"),
                     row_digest([F.col(f) for f in fields]).alias("digest"), row_digest([now[f] for f in fields]).alias("claimed"))
    rows, most = _placed(rows, "tree", ["id", "digest"])
    levels, subroots = _grown(rows, most, ("id", "claimed"), fanout)
    groups = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    groups, n_groups = _placed(groups, "tree", ["name"])
    upper, root = _grown(groups, n_groups, ("name",), fanout)
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    tops = _paths(upper, root.withColumn("path", none), groups, ("name",), fanout)
    tops = settle(tops.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path"))
    out = _paths(levels, tops, rows, ("id", "claimed"), fanout)
    return out.select(F.col("id").alias(doc_id), F.col("digest").alias("leaf"), "claimed", "subroot", "root", "path")


def tamper_proof(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, checked against a copy in which every fifth text, by CRC-32 of its id, has lost its capitals.

    A null id has no CRC: its row isn't tampered with.
    """
    touched = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(touched, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), changed={"text": text})
    rows = rows.withColumn("folded_root", fold(F.col("claimed"), F.col("path"))).withColumn("proof_sha256", proof_digest(F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
