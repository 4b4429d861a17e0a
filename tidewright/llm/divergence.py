"""Source divergence audit: how far the words of each source stray from those of every other source of its language, in whole numbers.

The cube of (source, source, term) is cut into cells: a block of sources by a block of sources by a block of terms. Each cell gets the two slices of
counts that it needs, adds up divergences over its terms for all its pairs, and the sums are reduced along the terms. Cells are of a bounded size, however
many sources and terms there are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import pieces, small_batches, tidy
from tidewright.session import settle

#: Sources in a block and terms in a block (by hash, so about as many): a cell has 2 · BLOCK · TERMS counts at most.
BLOCK, TERMS = 32, 8192
#: Terms that a task counts before it hands them on.
HELD = 200_000
#: Rows of the table of sources up to which it is sent to every task (under 200 bytes a row).
FEW_GROUPS = 50_000
#: Shares are whole numbers of billionths.
SCALE = 1_000_000_000
# ASCII letters in lower case and all bytes above ASCII stay; the rest parts terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _tally(batches):
    """Counts by (lang, source, term) of a task's texts, and a row without a term for each of its groups."""
    counts: dict = {}
    held = 0

    def rows():
        lang, source, term, n, docs = [], [], [], [], []
        for (a, b), (words, texts) in counts.items():
            lang += [a] * (len(words) + 1)
            source += [b] * (len(words) + 1)
            term += [None, *words]
            n += [0, *words.values()]
            docs += [0, *(texts[w] for w in words)]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()),
                                           pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    for whole in batches:
        for batch in pieces(whole, "text"):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                words, texts = counts.setdefault((lang, source), (Counter(), Counter()))
                own, before = text.translate(_TERMS).split(), len(words)
                words.update(own)
                texts.update(set(own))
                held += len(words) - before + 1
                if held > HELD:
                    yield rows()
                    held = 0
    if counts:
        yield rows()


def _scaled(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE · (count + 1) / (total + terms)) by long division in thousands: exact while total + terms is below 9 · 10^15."""
    whole = f"({total} + {terms})"
    rest, out = f"({count} + 1)", "1"
    for unit in (1_000_000, 1_000, 1):
        out += f" + {unit} * ({rest} * 1000 div {whole})"
        rest = f"({rest} * 1000 % {whole})"
    return F.expr(f"case when {terms} > 0 then {out} else 1 end")


def _gap(p: str, q: str) -> Column:
    """floor((p - q)² / q): below 2^63, since shares are at most SCALE + 1."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _cell(key, table):
    """Divergence sums of all ordered pairs of one cell, and the number of terms that its sources have."""
    i, j = key[1].as_py(), key[2].as_py()
    heads = table.filter(pa.compute.is_null(table.column("term")))
    number, share = heads.column("number").to_numpy(), heads.column("p").to_numpy()
    order = np.argsort(number)
    number, share = number[order], share[order]
    body = table.filter(pa.compute.is_valid(table.column("term"))).combine_chunks()
    terms = pa.compute.dictionary_encode(body.column("term")).combine_chunks() if body.num_rows else None
    width = len(terms.dictionary) if body.num_rows else 0
    p = np.repeat(share[:, None], width, axis=1)
    if width:
        p[np.searchsorted(number, body.column("number").to_numpy()), terms.indices.to_numpy()] = body.column("p").to_numpy()
    left, right = np.flatnonzero(number // BLOCK == i), np.flatnonzero(number // BLOCK == j)
    one, other, sums = [], [], []
    for mine, theirs in ((left, right),) if i == j else ((left, right), (right, left)):
        for a in mine:
            rest = theirs[theirs != a]
            d = p[a] - p[rest]
            one.append(np.full(len(rest), number[a]))
            other.append(number[rest])
            sums.append((d * d // p[rest]).sum(axis=1))
    flat = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (one, other, sums)]
    n = len(flat[0])
    return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "one": flat[0], "other": flat[1], "value": flat[2], "present": np.full(n, width, np.int64)})


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang one other value``: divergence of each source (by number) from each other one of its language over all kept terms.

    Terms that neither source of a pair has count alike in all cells, so they are added by number at the end.
    """
    def dealt(rows: DataFrame) -> DataFrame:
        """Rows in the cells of their source block with each block, smaller block first."""
        rows = rows.withColumn("mine", F.expr(f"number div {BLOCK}")).withColumn("block", F.explode(F.expr(f"sequence(0L, (groups - 1) div {BLOCK})")))
        return rows.select("lang", F.least("mine", "block").alias("i"), F.greatest("mine", "block").alias("j"), "k", "term", "number", "p")

    cut = F.expr(f"greatest(1L, (terms + {TERMS - 1}) div {TERMS})")
    body = kept.withColumn("k", F.pmod(F.xxhash64("term"), cut))
    heads = groups.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1))).withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("p_none"))
    cells = dealt(body).unionByName(dealt(heads)).groupBy("lang", "i", "j", "k").applyInArrow(_cell, "lang string, one long, other long, value long, present long")
    sums = cells.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))
    side = groups.select("lang", F.col("number").alias("one"), "source", "terms", F.col("p_none").alias("p"))
    item = groups.select("lang", F.col("number").alias("other"), F.col("source").alias("item"), F.col("p_none").alias("q"))
    named = sums.join(side, ["lang", "one"]).join(item, ["lang", "other"])
    return named.select("lang", "source", "item", (F.col("value") + (F.col("terms") - F.col("present")) * _gap("p", "q")).alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200) -> DataFrame:
    """``lang source part item value rank``: for each source, all other sources of its language (``pair``) by how far its shares of words stray from
    theirs, and the ``top`` words (``term``) by which it strays most above its language.

    Terms are runs of ASCII letters (A-Z in lower case) and non-ASCII characters in at least ``least_docs`` documents of a language. A share is
    1 + floor(10^9 (count + 1) / (all counts + all terms)); a value floor((p - q)² / q), summed over all kept terms of the language for pairs.
    Null text, language or source reads as the empty string, which is a source or language like others. Sources without terms, and languages of which no term is kept
    (value 0), have their pairs. Repeated rows and ids: each row is a document. Ties rank by name, bytewise. No rows: none. Other columns aren't read.

    Texts are counted where they are read; what moves is a row per task, source and term. Each source's ``top`` terms are picked in every task first.
    """
    small_batches(docs.sparkSession)
    thin = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))],
                       F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    partial = thin.mapInArrow(tidy(_tally), "lang string, source string, term string, n long, docs long")
    counted = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    alike = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"all_docs": F.sum("docs").over(alike), "all_n": F.sum("n").over(alike), "first": F.col("source") == F.min("source").over(alike)})
    counted = settle(counted.where(F.col("term").isNull() | (F.col("all_docs") >= least_docs)).drop("docs", "all_docs"))

    named = F.col("term").isNotNull()
    groups = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.coalesce(F.sum((F.col("first") & named).cast("long")), F.lit(0)).alias("firsts"))
    own = Window.partitionBy("lang")
    groups = groups.withColumns({"number": F.row_number().over(own.orderBy("source")).cast("long") - 1, "groups": F.count("*").over(own), "terms": F.sum("firsts").over(own),
                                 "all_total": F.sum("total").over(own)}).drop("firsts")
    groups = settle(groups.withColumn("p_none", _scaled("0L", "total", "terms")))
    few = groups.count() <= FEW_GROUPS
    kept = counted.where(named).join(F.broadcast(groups) if few else groups, ["lang", "source"])
    kept = kept.withColumns({"p": _scaled("n", "total", "terms"), "q": _scaled("all_n", "all_total", "terms")})

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = kept.where("p > q").select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"))
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    pairs = _pairs(kept, groups).withColumn("rank", F.row_number().over(best))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*cols).unionByName(over.withColumn("part", F.lit("term")).select(*cols))
