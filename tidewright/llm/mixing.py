"""Mixing sources to target weights: systematic sampling over prefix sums of expected copies. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import settle

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _named(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("-"))


def fill_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """Target of each source: ``share`` of all sizes, dealt by weight, none above ``limit`` times its own size.

    ``sizes`` has a row per source. Sources take ``weights`` in turn, by code point, null last. Sharing out the excess again
    and again ends at one level: sources are filled in the order of limit·size/weight, and the level is that of the first one
    which doesn't overflow. Adds ``_target``.
    """
    k = len(weights)
    turn = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))
    rows = sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn - 1) % k + 1))
    rows = rows.withColumn("_full", F.col(size) * F.lit(float(limit)))
    fill = Window.orderBy(F.col("_full") / F.col("_weight"), F.col(source).asc_nulls_last())
    upto, whole = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    rows = rows.withColumn("_level", (F.sum(size).over(whole) * F.lit(float(share)) - (F.sum("_full").over(upto) - F.col("_full")))
                           / (F.sum("_weight").over(whole) - (F.sum("_weight").over(upto) - F.col("_weight"))))
    rows = rows.withColumn("_capped", F.col("_full") <= F.col("_weight") * F.col("_level"))
    level = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(whole)
    rows = rows.withColumn("_target", F.when(F.col("_capped") | level.isNull(), F.col("_full")).otherwise(F.col("_weight") * level))
    return rows.drop("_weight", "_full", "_level", "_capped")


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", weights: Sequence[float] = (3, 1, 2),
        share: float = 1.5, limit: float = 2.0, seed: int = 7) -> DataFrame:
    """Every row of ``df`` with ``_source_size``, ``_target`` (its source's) and ``_copies``, how often the mix takes it.

    Each document of a source is expected target/size times. Documents of a source stand in one order; prefix sums of the expected copies
    plus one offset for the source, drawn by hash from ``seed``, give a copy for each integer passed. In the order, sizes go
    up over every second document and down over the rest, so that what one half takes too much of, the other takes too little of:
    words taken stay within about one long document of the target. ``limit`` bounds the copies of each document, and reruns agree:
    order and offset hang on ids, sizes and names only.

    A range sort deals the rows out, so a source with a third of all rows is spread over many tasks; offsets between them come
    from a row per source and task. Null source: a source of its own. Size 0 or null: counts nothing, may be taken. Null ids and repeated rows:
    each row is a document. No rows: none. Columns of ``df`` other than those added stay as they are.
    """
    rows = df.withColumns({"_mix_source": _named(source), "_mix_size": F.coalesce(F.col(size), F.lit(0)).cast("long"),
                           "_mix_tie": F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")))})
    order = ["_mix_source", "_mix_size", "_mix_tie"]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_mix_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_mix_part", F.shiftright("_mix_at", 33))
    parts = rows.groupBy("_mix_source", "_mix_part").agg(
        F.min("_mix_at").alias("_mix_from"), F.count("*").alias("_mix_rows"), F.sum("_mix_size").alias("_mix_sum"),
        F.first(source).alias("_mix_name"))
    own = Window.partitionBy("_mix_source")
    upto = own.orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = settle(parts.withColumns({"_mix_before": F.sum("_mix_rows").over(upto) - F.col("_mix_rows"), "_mix_all": F.sum("_mix_rows").over(own),
                                      "_source_size": F.sum("_mix_sum").over(own)}))
    sources = parts.groupBy("_mix_source", "_source_size").agg(F.first("_mix_name").alias("_mix_name"))
    sources = fill_targets(sources, "_mix_name", "_source_size", weights, share, limit).select("_mix_source", "_target")
    parts = parts.drop("_mix_rows", "_mix_sum", "_mix_name").join(sources, "_mix_source")
    rank = F.col("_mix_at") - F.col("_mix_from") + F.col("_mix_before")
    place = F.when(F.col("_mix_rank") % 2 == 0, F.expr("_mix_rank div 2")).otherwise(F.col("_mix_all") - 1 - F.expr("(_mix_rank - 1) div 2"))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    start = F.conv(F.substring(F.md5(F.concat(F.col("_mix_source"), F.lit(f"|{seed}"))), 1, 5), 16, 10).cast("long") / F.lit(float(2**20))
    out = rows.join(parts, ["_mix_source", "_mix_part"]).withColumn("_mix_rank", rank).withColumn("_mix_place", place)
    copies = F.floor(rate * (F.col("_mix_place") + 1) + start) - F.floor(rate * F.col("_mix_place") + start)
    return out.withColumn("_copies", copies.cast("long")).select(*df.columns, "_source_size", "_target", "_copies")


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as ``_copies`` says, without the added columns."""
    kept = [c for c in mixed.columns if c not in ("_source_size", "_target", "_copies")]
    return mixed.where("_copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1, _copies)"))).select(*kept)
