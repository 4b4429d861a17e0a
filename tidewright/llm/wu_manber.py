"""Benchmark decontamination by Wu-Manber search: all windows of benchmark words are looked for at once in every text.

Symbols are words, a block is two of them. A shift table says how far the search may go on when it stands behind a block: past all positions in which no
window can stand. Where it says 0, the block picks a bucket of windows, and these are compared with the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewright.llm.common import map_texts, pieces, small_batches, tidy
from tidewright.session import settle

#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Bytes of benchmark words that one search holds (its tables take some twelve times as many) and of a piece of an item.
PART_BYTES, PIECE_BYTES = 4 << 20, 64 << 10
#: Lengths from which windows are searched together: the shortest one bounds the shifts.
CLASSES = (10, 5, 3, 2, 1)
# Letters and digits in lower case and all bytes above ASCII stay; the rest parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPANS = "n_words long, spans array<struct<start: int, stop: int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class _Search:
    """Windows of some lengths, the shortest of ``least`` words."""

    def __init__(self, least: int, windows: dict[tuple[bytes, ...], int]):
        self.least, self.block = least, min(2, least)
        self.most = least - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for w, number in windows.items():
            for end in range(self.block, least + 1):
                key = self._key(w, end)
                self.shift[key] = min(self.shift.get(key, self.most), least - end)
            # the bucket of the last block holds the window's first words, and behind them what may follow, by length
            tails = self.buckets.setdefault(self._key(w, least), {}).setdefault(w[:least], {})
            tails.setdefault(len(w) - least, {})[w[least:]] = number

    def _key(self, words: Sequence[bytes], end: int):
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def __call__(self, words: list[bytes]) -> Iterable[tuple[int, int, int]]:
        """(start, stop, number) of each occurrence."""
        least, most, shift, n, at = self.least, self.most, self.shift, len(words), self.least
        if self.block == 1:
            stops = (i + 1 for i, w in enumerate(words) if w in shift)
        else:
            stops = []
            while at <= n:
                skip = shift.get((words[at - 2], words[at - 1]), most)
                if not skip:
                    stops.append(at)
                at += skip or 1
        for stop in stops:
            start = stop - least
            for length, tails in self.buckets[self._key(words, stop)].get(tuple(words[start:stop]), {}).items():
                number = tails.get(tuple(words[stop: stop + length])) if length else tails[()]
                if number is not None:
                    yield start, stop + length, number


class Finder:
    """Search over items given as (id, words)."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        numbers: dict[tuple[bytes, ...], int] = {}
        self.owners: list[set[str]] = []
        for name, words in items:
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                number = numbers.setdefault(tuple(words[i: i + size]), len(numbers))
                if number == len(self.owners):
                    self.owners.append(set())
                self.owners[number].add(name)
        classes = sorted({min(c, window) for c in CLASSES} | {window}, reverse=True)
        sorted_out: dict[int, dict] = {}
        for w, number in numbers.items():
            sorted_out.setdefault(next(c for c in classes if c <= len(w)), {})[w] = number
        self.searches = [_Search(least, windows) for least, windows in sorted_out.items()]

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of words inside occurrences, and the items whose windows occur."""
        found, numbers = [], set()
        for search in self.searches:
            for start, stop, number in search(words):
                found.append((start, stop))
                numbers.add(number)
        return merged(found), set().union(*(self.owners[i] for i in numbers))


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending spans that neither overlap nor touch."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def item_parts(items: DataFrame, item_id: str, text: str, window: int, part_bytes: int) -> list[DataFrame]:
    """Distinct pieces of items (``name``, ``words`` in one string) in parts of at most ``part_bytes``, so that each can be sent to every task.

    A piece has about PIECE_BYTES; neighbours share ``window`` - 1 words, so no window is lost. Parts are dealt by hash, more of them until each fits.
    """
    def cut(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                names, words = [], []
                for name, t in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                    own, start, size = words_of(t), 0, 0
                    for i, w in enumerate(own):
                        size += len(w) + 1
                        if size > PIECE_BYTES and i - start >= window:
                            names.append(name)
                            words.append(b" ".join(own[start: i]))
                            start, size = i - window + 1, sum(map(len, own[i - window + 1: i + 1])) + window
                    if own:
                        names.append(name)
                        words.append(b" ".join(own[start:]))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.binary())], ["name", "words"])

    thin = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(text).cast("string").alias("text"))
    cells = settle(thin.mapInArrow(tidy(cut), "name string, words binary").distinct().withColumn("size", F.octet_length("words") + F.octet_length("name") + 16))
    total = cells.agg(F.sum("size"), F.max("size")).first()
    n = max(1, math.ceil((total[0] or 0) / part_bytes))
    limit = max(part_bytes, total[1] or 0)
    while n > 1 and cells.groupBy(F.pmod(F.xxhash64("name", "words"), F.lit(n))).agg(F.sum("size").alias("b")).where(F.col("b") > limit).limit(1).count():
        n *= 2
    return [cells.where(F.pmod(F.xxhash64("name", "words"), F.lit(n)) == i).select("name", "words") for i in range(n)]


def _searcher(part: DataFrame, window: int) -> Callable:
    """What a task runs over its texts. The part is of a bounded size and goes to every worker once."""
    shared = part.sparkSession.sparkContext.broadcast([(r["name"], bytes(r["words"])) for r in part.collect()])

    def make():
        find = Finder(((name, words.split()) for name, words in shared.value), window)
        def fn(texts):
            counts, spans, items = [], [], []
            for t in texts:
                words = words_of(t)
                at, names = find(words)
                counts.append(len(words))
                spans.append([{"start": a, "stop": b} for a, b in at])
                items.append(sorted(names))
            return counts, spans, items
        return fn
    return make


def find_passages(docs: DataFrame, items: DataFrame, keep: Sequence[str], text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``keep`` with ``n_words``, ``spans`` (words inside occurrences of benchmark windows, merged) and ``items`` (ids whose windows occur, sorted as strings).

    Words are runs of ASCII letters (A-Z in lower case), digits and non-ASCII characters. A window is ``window`` consecutive words of an item; an item of fewer
    words is one window; one without words has none. Null or empty text: no words. Null item id: the empty id. Items or documents that repeat: an id counts once,
    each document row by itself. No items: nothing is found; no documents: no rows. Columns of ``docs`` that aren't kept don't matter.

    Documents stay where they are read. Items beyond ``part_bytes`` are searched in several parts, one pass over the texts for each, and what is found for a row is merged.
    """
    parts = item_parts(items, item_id, item_text, window, part_bytes)
    if len(parts) == 1:
        return map_texts(docs, keep, text, _searcher(parts[0], window), SPANS)
    small_batches(docs.sparkSession)
    rows = settle(docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row")))
    found = None
    for part in parts:
        some = settle(map_texts(rows, ["_row"], "_text", _searcher(part, window), SPANS).where("size(items) > 0"))
        found = some if found is None else found.unionByName(some)
    # a row meets at most one entry for each part
    found = found.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    added = StructType.fromDDL("n_words long, spans array<struct<start: int, stop: int>>, items array<string>")
    schema = StructType([docs.schema[c] for c in keep] + list(added))
    arrow = to_arrow_schema(schema)

    def finish(batches):
        for batch in batches:
            spans = [[{"start": a, "stop": b} for a, b in merged((s["start"], s["stop"]) for s in x or [])] for x in batch.column("spans").to_pylist()]
            cols = [batch.column(i) for i in range(len(keep))] + [batch.column("n_words"), pa.array(spans), batch.column("items")]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    words = F.length(F.regexp_replace(F.regexp_replace(F.coalesce("_text", F.lit("")), WORD, "w"), "[^w]", "")).cast("long")
    counted = rows.select(*[f"_keep{i}" for i in range(len(keep))], words.alias("n_words"), "_row")
    out = counted.join(found, "_row", "left").select(*[f"_keep{i}" for i in range(len(keep))], "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.mapInArrow(tidy(finish), schema)


#: A word, as a pattern.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Counts, a digest of the items' ids and the verdict for each document: contaminated if any word is hit."""
    rows = find_passages(docs, items, ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
