"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import settle

#: Bits of a document's hash, the first 15 hex digits of MD5 of its id.
BITS = 60


def id_hash(doc_id: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("-"))), 1, 15), 16, 10).cast("long")


def _prefix(h: str, depth) -> Column:
    """The first ``depth`` bits of a hash, as a number."""
    return F.expr(f"shiftright({h}, {BITS} - {depth})")


def directory(rows: DataFrame, limit: int, step: int = 6) -> DataFrame:
    """Leaves (``depth``, ``prefix``, ``shard_bytes``, ``shard_docs``) for rows with ``h`` and ``size``.

    A bucket is a leaf when it fits and the bucket that it was split from doesn't. Splits go ``step`` bits and more at a time: each round
    counts bytes by the next bits for rows of buckets that are still too large, and adds them up along the prefixes, so
    rows are read once for nearly all data. A bucket whose rows have all the same hash can't be split and stays as it is.
    """
    total = rows.agg(F.sum("size").alias("b")).first()["b"] or 0
    top, leaves, todo = 0, None, rows
    depth = max(1, math.ceil(math.log2(max(1.0, total / limit)))) + step
    while True:
        depth = min(depth, BITS)
        cells = settle(todo.groupBy(_prefix("h", depth).alias("cell")).agg(
            F.sum("size").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("lo"), F.max("h").alias("hi")))
        nodes = cells.withColumn("depth", F.explode(F.expr(f"sequence({top}, {depth})"))).withColumn(
            "prefix", F.expr(f"shiftright(cell, {depth} - depth)")).groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        nodes = settle(nodes.withColumn("splits", (F.col("bytes") > limit) & (F.col("lo") < F.col("hi"))))
        parents = nodes.where("splits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        found = nodes.where("not splits").withColumn("up", F.shiftright("prefix", 1))
        if top == 0:
            roots = found.where("depth = 0")
            found = found.join(parents, ["depth", "up"], "left_semi").unionByName(roots)
        else:
            found = found.where(F.col("depth") > top).join(parents, ["depth", "up"], "left_semi")
        found = found.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
        leaves = found if leaves is None else leaves.unionByName(found)
        large = nodes.where((F.col("depth") == depth) & F.col("splits")).select(F.col("prefix").alias("cell"))
        if depth == BITS or large.isEmpty():
            return settle(leaves)
        todo = todo.withColumn("cell", _prefix("h", depth)).join(large, "cell", "left_semi").drop("cell")
        top, depth = depth, depth + step + 4


def shard(df: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 16 << 20) -> DataFrame:
    """The shard of each row: ``doc_id``, ``n_bytes`` (UTF-8), ``shard`` (its hash prefix in bits, ``*`` for the whole), ``depth``,
    ``shard_bytes`` and ``shard_docs``.

    Every shard fits ``limit`` bytes, unless it is one document or repeats of one id, which no further bit can part. Null text: 0 bytes.
    Null ids hash alike. Empty table: no rows. Only ids and sizes are shuffled, never texts.
    """
    rows = settle(df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
                  .withColumn("h", id_hash("doc_id")))
    leaves = directory(rows, limit)
    depths = [r["depth"] for r in leaves.select("depth").distinct().collect()]  # 61 at most
    # each row looks up the one depth at which its prefix is a leaf: an equi-join per depth in use, told apart by the key
    tried = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]))) if depths else rows.withColumn("depth", F.lit(0))
    tried = tried.withColumn("prefix", F.expr(f"shiftright(h, {BITS} - depth)"))
    out = tried.join(leaves, ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, F.lit("*")).otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')"))
    return out.select("doc_id", F.col("size").alias("n_bytes"), name.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs")


def write_shards(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 16 << 20) -> DataFrame:
    """Write the rows of ``df`` under ``path``, a folder ``shard=<bits>`` each, and return the directory that was used."""
    leaves = shard(df, doc_id, text, limit).select("doc_id", "shard").dropDuplicates()
    rows = df.withColumn("_id", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")))
    keyed = rows.join(leaves.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("_id"), "shard"), "_id").drop("_id")
    keyed.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    return df.sparkSession.read.parquet(path).groupBy("shard").agg(F.count("*").alias("docs"))
