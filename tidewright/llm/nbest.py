"""SentencePiece encoding with the N best segmentations: forward Viterbi scores guide an exact backward A* search over the piece lattice.

No piece of the vocabularies served crosses a space or a line end, so the lattice of a text is a chain of small ones, one per word. A* runs on the
word lattices (kept for words met again) and the N best of the text are the N smallest sums of their excess costs: at most
N - 1 words leave their best path, those whose second best path is nearest to it.
"""

from __future__ import annotations

import heapq
import math
import re
import string
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.common import map_texts, worker_state

SPACE = "▁"
#: Stands for a SPACE mark that a text itself holds; no text can hold this code point.
MARK = "\udbff"
#: Words whose segmentations a worker keeps (about 220 bytes each), twice: those met since the last change and those before.
CACHE = 50_000
#: Bytes of text segmented before results leave the worker: what it holds of them is many times as large.
HELD_BYTES = 1 << 20
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
_WORDS = re.compile(r" +[^ \n]*|[^ \n]+|\n")


def model_bytes(path: str | None = None) -> bytes:
    """The model file; the driver reads it once and tasks get its bytes (0.5 MB)."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


class Segmenter:
    """Encoder and decoder over the pieces of a model.

    The cost of a piece is its information under Zipf's law for its rank in the model, ln(rank + 2.7) + ln(sum of 1/(rank + 2.7)), in millionths,
    as integers: sums are exact, and ties are ties. A character without a piece falls back to its bytes, 12 each.
    """

    def __init__(self, model: bytes, cache: int = CACHE):
        self.cache = cache
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        total = math.log(sum(1 / (k + 2.7) for k in range(len(plain))))
        self.pieces = {sp.id_to_piece(i): (i, round(1e6 * (math.log(2.7 - sp.get_score(i)) + total))) for i in plain}
        self.byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.as_bytes = [b""] * size
        for p, (i, _) in self.pieces.items():
            self.as_bytes[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.as_bytes[i] = bytes([b])
        if any(SPACE in p.strip(SPACE) or "\n" in p or p.endswith(SPACE) and p.strip(SPACE) for p in self.pieces):
            raise ValueError("a piece of this model crosses words")
        # marks that no piece holds behind a letter: words end before them, so that they are met again whatever follows them
        marks = "".join(c for c in string.punctuation if not any(re.search(rf"[{_LETTERS}]{re.escape(c)}", p) for p in self.pieces))
        self.cut = re.compile(rf"[{re.escape(marks)}](?<=[{_LETTERS}].)" if marks else r"(?!)")
        # pieces, and with () whatever a longer piece begins with
        self.table: dict[str, tuple] = {p[:k]: () for p in self.pieces for k in range(1, len(p))} | self.pieces
        self.typed, self.code = (np.uint16, "H") if size <= 1 << 16 else (np.uint32, "I")
        self.known: dict[str, int] = {}  # word: place in costs, ids and gaps
        self.costs, self.ids, self.gaps = array("q"), [], array("q")
        self.aged: tuple = ({}, self.costs, self.ids, self.gaps)

    def words(self, text: str) -> list[str]:
        """The parts of a text that no piece crosses: a word with the spaces before it, a line end."""
        if SPACE in text:
            text = text.replace(SPACE, MARK)
        if "  " in text or text[:1] == " " or "\0" in text:
            return _WORDS.findall(" " + text)
        words = (" " + self.cut.sub("\0\\g<0>", text).replace(" ", "\0 ").replace("\n", "\0\n\0")).split("\0")
        return [w for w in words if w] if "\n" in text else words

    def lattice(self, word: str) -> tuple[list[list[tuple]], list[int]]:
        """Edges (start, (ids, cost)) by the position where they end, and the least cost from the start to every position (Viterbi)."""
        n, get = len(word), self.table.get
        edges: list[list[tuple]] = [[] for _ in range(n + 1)]
        best = [0] + [1 << 60] * n
        for start in range(n):
            base = best[start]
            hit = known = get(word[start])
            if not hit:  # no piece for this character
                raw = (SPACE if word[start] == MARK else word[start]).encode()
                hit = (tuple([self.byte_ids[b] for b in raw]), 12_000_000 * len(raw))
            edges[start + 1].append((start, hit))
            if base + hit[1] < best[start + 1]:
                best[start + 1] = base + hit[1]
            if known is None:  # nor one that begins with it
                continue
            for end in range(start + 2, n + 1):
                hit = get(word[start:end])
                if hit:
                    edges[end].append((start, hit))
                    cost = base + hit[1]
                    if cost < best[end]:
                        best[end] = cost
                elif hit is None:
                    break
        return edges, best

    def paths(self, word: str, n: int) -> list[tuple[int, tuple]]:
        """The n cheapest (cost, ids) of a word, cheapest first: A* from the end, with the exact rest of the way as its estimate.

        Among equal totals the path nearest to the start goes on, so each of the n takes no more steps than the word has characters, even
        where very many paths cost the same.
        """
        word = word.replace(" ", SPACE)
        edges, best = self.lattice(word)
        heap, count, found = [(best[-1], len(word), 0, 0, None)], 0, []
        while heap and len(found) < n:
            _, at, _, g, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path:
                    x, path = path
                    ids += x if type(x) is tuple else (x,)
                found.append((g, tuple(ids)))
                continue
            for start, (x, cost) in edges[at]:
                count += 1
                heapq.heappush(heap, (g + cost + best[start], start, count, g + cost, (x, path)))
        return found

    def best_of(self, word: str) -> tuple[int, bytes, int]:
        """(cost of the best path, its ids as bytes, excess of the second best) of a word.

        The search without its heap: as estimates are exact, it first follows the best path, and what it leaves aside on the way holds the second best.
        """
        edges, best = self.lattice(word.replace(" ", SPACE))
        ids, at, gap = [], len(word), 1 << 60
        while at:
            took, here = None, best[at]
            for edge in edges[at]:
                over = best[edge[0]] + edge[1][1] - here
                if over == 0 and took is None:
                    took = edge
                elif over < gap:
                    gap = over
            at, (x, _) = took
            if type(x) is tuple:
                ids += x[::-1]
            else:
                ids.append(x)
        ids.reverse()
        return best[-1], array(self.code, ids).tobytes(), gap

    def _learn(self, word: str) -> int:
        """The place of a word's entry, which is made, or taken over from those before the last change."""
        at = self.known.get(word)
        if at is None:
            old = self.aged[0].get(word)
            cost, ids, gap = self.best_of(word) if old is None else (self.aged[1][old], self.aged[2][old], self.aged[3][old])
            at = self.known[word] = len(self.ids)
            self.costs.append(cost)
            self.ids.append(ids)
            self.gaps.append(gap)
        return at

    def ways(self, text: str, n: int) -> tuple[int, list[bytes], list[tuple[int, tuple]]]:
        """Cost and ids by word of the best segmentation, and the n best ones as (excess cost, changes), a change being (word number, ids, ids before)."""
        if len(self.known) >= self.cache:  # words not met again since the last change leave
            self.aged = (self.known, self.costs, self.ids, self.gaps)
            self.known, self.costs, self.ids, self.gaps = {}, array("q"), [], array("q")
        words = self.words(text)
        places = list(map(self.known.get, words))
        if None in places:
            places = [self._learn(w) if p is None else p for w, p in zip(words, places)]
        at, ids = np.array(places), self.ids
        ways = [(0, ())]
        if n > 1:
            gaps = np.array(self.gaps, copy=False)[at]
            near = np.argpartition(gaps, n - 2)[: n - 1] if len(gaps) > n - 1 else np.arange(len(gaps))
            for k in sorted(near.tolist()):
                base, *more = self.paths(words[k], n)
                choices = [(0, None)] + [(c - base[0], (k, new, base[1])) for c, new in more]
                ways = sorted(((d + e, (*chosen, alt) if alt else chosen) for d, chosen in ways for e, alt in choices), key=lambda x: x[0])[:n]
        return int(np.array(self.costs, copy=False)[at].sum()), [ids[p] for p in places], ways

    def encode(self, text: str | None, n: int = 4) -> list[tuple[int, np.ndarray]]:
        """The n cheapest (cost in millionths, ids) of a text, cheapest first; fewer if it has fewer. No text: one without ids."""
        if not text:
            return [(0, np.empty(0, self.typed))]
        cost, parts, ways = self.ways(text, n)
        out = []
        for d, chosen in ways:
            mine = parts.copy() if chosen else parts
            for k, ids, _ in chosen:
                mine[k] = np.array(ids, self.typed).tobytes()
            out.append((cost + d, np.frombuffer(b"".join(mine), self.typed)))
        return out

    def raw(self, ids) -> bytes:
        table = self.as_bytes
        return b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])

    def decode(self, ids) -> str:
        """The text of a segmentation: its pieces' bytes, without the space put before the first word."""
        return self.raw(ids).decode("utf-8", "surrogatepass")[1:]


def _pass(df: DataFrame, keep: list[str], text: str, model: bytes, cache: int, adds: str, rows: Callable) -> DataFrame:
    """``rows(segmenter, texts)`` over all texts, with one segmenter per Python worker, which knows the words of earlier tasks."""
    def make():
        own = worker_state(("pieces", model, cache), lambda: Segmenter(model, cache))
        return lambda texts: rows(own, texts)

    return map_texts(df, keep, text, make, adds, most=HELD_BYTES)


def encode_nbest(df: DataFrame, keep: list[str], text: str = "text", n: int = 4, model: bytes | None = None, cache: int = CACHE) -> DataFrame:
    """``keep`` with ``ids`` (the best segmentation), its ``score`` and ``alternatives``, the others of the n best.

    An alternative has its ``score`` and ``changes``: from token ``at`` on, ``n`` ids give way to ``ids``. Scores are log-probabilities.
    Null and empty texts have no ids and score 0. Whole texts, whatever their length; every row on its own.
    """
    def rows(own, texts):
        ids, scores, others = [], [], []
        for t in texts:
            if not t:
                ids.append(np.empty(0, np.int32))
                scores.append(0.0)
                others.append([])
                continue
            cost, parts, ways = own.ways(t, n)
            ids.append(np.frombuffer(b"".join(parts), own.typed).astype(np.int32))
            scores.append(-cost / 1e6)
            wide = own.typed().itemsize
            at = {k: sum(map(len, parts[:k])) // wide for _, chosen in ways for k, _, _ in chosen}
            others.append([{"score": -(cost + d) / 1e6, "changes": [{"at": at[k], "n": len(old), "ids": list(new)} for k, new, old in chosen]}
                           for d, chosen in ways[1:]])
        ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))), scores, others]

    return _pass(df, keep, text, model or model_bytes(), cache,
                 "ids array<int>, score double, alternatives array<struct<score:double,changes:array<struct<at:int,n:int,ids:array<int>>>>>", rows)


def nbest_digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, model: bytes | None = None, cache: int = CACHE) -> DataFrame:
    """What is needed to check segmentations without moving them: a row per row of ``df``.

    ``n_chars``, ``n_tokens`` and ``ids_crc32`` (ids as little-endian unsigned 32-bit) of the best one, ``scores`` and ``lengths`` of the n best, ``exact``: all of
    them decode to the text. Null text: as empty, 0 tokens.
    """
    def one(own, t):
        if not t:
            return 0, 0, 0, [0.0], [0], True
        cost, parts, ways = own.ways(t, n)
        ids = np.frombuffer(b"".join(parts), own.typed)
        exact = own.decode(ids) == t and all(own.raw(new) == own.raw(old) for _, chosen in ways for _, new, old in chosen)
        return (len(t), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), [-(cost + d) / 1e6 for d, _ in ways],
                [len(ids) + sum(len(new) - len(old) for _, new, old in chosen) for _, chosen in ways], exact)

    return _pass(df.withColumnRenamed(doc_id, "doc_id"), ["doc_id"], text, model or model_bytes(), cache,
                 "n_chars long, n_tokens long, ids_crc32 long, scores array<double>, lengths array<int>, exact boolean",
                 lambda own, texts: list(zip(*[one(own, t) for t in texts])) if texts else [[]] * 6)
