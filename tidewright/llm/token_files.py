"""Token ids in Arrow files: equal-length sequences with masks as fixed-size lists, read again without copying.

A file (Arrow IPC, the stream format with a footer) holds rows of one length: ``ids``, ``mask`` (false: filling at the end of the file), ``ends`` (true: last id of a
document) and ``docs``, the ids of the documents that end in the row. Since ids and masks are fixed-size lists, row i of a batch lies at a known place of the
mapped file. Files hold whole documents in ascending id order, and ascend by name.
"""

from __future__ import annotations

import itertools
import operator
import os
import re
import string
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import LOWEST, id_ranges, map_texts, partitions_of, tidy, worker_state
from tidewright.session import checkpoint_dir, settle

#: Ids of a sequence, sequences of a batch, ids after which a file ends with the document at hand.
LENGTH, BATCH, FILE_IDS = 1024, 512, 16 << 20
#: Put behind each document.
END = 1
#: Words whose ids a worker keeps (about 150 bytes each), twice: those met since the last change and those before.
CACHE = 600_000


def tokenizer_json(path: str | None = None) -> str:
    """The vocabulary file, read by the driver; tasks get its text (under 2 MB)."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


# Kinds of bytes, as tables for bytes.translate: 1 ASCII letters, 2 ASCII marks, 4 second bytes of letters from À to ÿ in UTF-8, 8 their first byte.
_LETTER, _MARK, _LATIN, _LEAD = 1, 2, 4, 8
_KIND = bytes(_LETTER if chr(c) in string.ascii_letters else _MARK if chr(c) in string.punctuation else _LEAD if c == 0xc3
              else _LATIN if 0x80 <= c <= 0xbf and c not in (0x97, 0xb7) else 0 for c in range(256))
# A-Z lowered, ASCII white space as spaces.
_LOWER = bytes(32 if chr(c) in string.whitespace else c + 32 if 65 <= c <= 90 else c for c in range(256))
# 1: bytes that words of the letters a-z and À to ÿ don't have.
_OTHER = bytes(0 if 97 <= c <= 122 or _KIND[c] & (_LATIN | _LEAD) else 1 for c in range(256))
# A word of them without a sign that special tokens begin with.
_PLAIN = re.compile(rb"(?:(?!<\|)[!-~]|\xc3[\x80-\xbf])+")
_FIRST = operator.itemgetter(0)
#: Texts by which a tokenizer shows whether its words can be encoded one by one.
PROBES = ("Ab cD  EF", "ab.cd, ef(gh) i-j", "a\tb\nc\r\nd", "\u00e9t\u00e9! \u00c9T\u00c9?x", "12 3a b4 5.6", " lead and trail ", "it's they're x_y", "\u6f22\u5b57 \u3042 mix\u00e9d")


class WordEncoder:
    """Ids of texts from a tokenizer that lowers case, drops white space and parts letters from marks, so that words can be encoded one by one and kept.

    Words stand between ASCII white space, end before a mark behind a letter (ASCII, or À to ÿ: the pre-tokenizer parts them), and have A-Z lowered. Texts in which
    a special token may stand are parted at white space only. The distinct words of a batch are looked up once; what a text consists of is put together by
    arrays. New words of letters go to the tokenizer without offsets: its model marks the last id of a word. A tokenizer that gives other ids for the words of
    PROBES than for the texts encodes whole texts.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.typed, self.code = (np.dtype("<u2"), "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (np.dtype("<u4"), "I")
        # Ids that end a word, where the model marks them.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closing = suffix and np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])
        self._clear()
        self.by_words = True
        self.by_words = all(self([t], None) == [self._whole(t)] for t in PROBES)
        self._clear()

    def _clear(self) -> None:
        """No words; those known so far become the aged ones."""
        self.aged = (self.known, self.flat, self.ends) if hasattr(self, "known") else ({}, array(self.code), array("q", [0]))
        self.known: dict[bytes, int] = {}  # word: its number n; its ids stand from ends[n] to ends[n + 1] in flat
        self.flat, self.ends = array(self.code), array("q", [0])

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _keep(self, words: list[bytes], lengths, ids) -> None:
        first = len(self.ends) - 1
        self.known.update(zip(words, range(first, first + len(words))))
        self.ends.frombytes((np.cumsum(lengths, dtype=np.int64) + self.ends[-1]).tobytes())
        self.flat.frombytes(np.asarray(ids, self.typed).tobytes())

    def _learn(self, words: list[bytes]) -> None:
        old, *stored = self.aged
        if old:
            found = list(map(old.get, words))
            met = [n for n in found if n is not None]
            if met:
                ids, upto = self._ids(np.array(met, np.int64), *stored)
                self._keep([w for w, n in zip(words, found) if n is not None], np.diff(upto, prepend=0), ids)
                words = [w for w, n in zip(words, found) if n is None]
        if self.closing is not None:
            words = self._learn_letters(words)
        simple = [_PLAIN.fullmatch(w) is not None for w in words]
        plain = list(itertools.compress(words, simple))
        for at in range(0, len(plain), 8192):  # words of ASCII and À to ÿ in one go: their ids are told apart by where they start
            some = plain[at: at + 8192]
            joined = b" ".join(some).decode()
            e = self.tokenizer.encode(joined, add_special_tokens=False)
            lengths = np.fromiter(map(len, some if joined.isascii() else joined.split(" ")), np.int64, len(some))
            starts = np.concatenate([[0], np.cumsum(lengths + 1)])
            begins = np.fromiter(map(_FIRST, e.offsets), np.int64, len(e))
            self._keep(some, np.diff(np.searchsorted(begins, starts)), e.ids)
        rest = [w for w, s in zip(words, simple) if not s]
        for at in range(0, len(rest), 4096):
            some = rest[at: at + 4096]
            got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in some], add_special_tokens=False)]
            self._keep(some, [len(x) for x in got], list(itertools.chain.from_iterable(got)))

    def _learn_letters(self, words: list[bytes]) -> list[bytes]:
        """Learn the words of a-z and À to ÿ, which are one word to the tokenizer too, so that its marks tell them apart; returns the others."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        others = np.flatnonzero(np.frombuffer(b"".join(words).translate(_OTHER), np.uint8))
        mixed = np.zeros(len(words), bool)
        mixed[np.searchsorted(np.cumsum(lengths), others, side="right")] = True
        letters, rest = list(itertools.compress(words, (~mixed).tolist())), list(itertools.compress(words, mixed.tolist()))
        for at in range(0, len(letters), 8192):
            some = letters[at: at + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.int64)
            stops = np.flatnonzero(self.closing[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                self._keep(some, np.diff(stops, prepend=0), ids)
            else:
                rest += some
        return rest

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words, new ones learnt."""
        if len(self.known) >= CACHE:  # words not met again since the last change leave
            self._clear()
        found = list(map(self.known.get, words))
        if None in found:
            new = [w for w, n in zip(words, found) if n is None]
            self._learn(new)
            learnt = map(self.known.__getitem__, new)
            found = [next(learnt) if n is None else n for n in found]
        return np.array(found, np.int64)

    def _ids(self, numbers: np.ndarray, flat: array | None = None, ends: array | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words in a row, where each word's end), from those kept now or from others."""
        flat, ends = np.frombuffer(self.flat if flat is None else flat, self.typed), np.frombuffer(self.ends if ends is None else ends, np.int64)
        start, length = ends[numbers], ends[numbers + 1] - ends[numbers]
        upto = np.cumsum(length)
        total = int(upto[-1]) if len(upto) else 0
        return flat[np.repeat(start - upto + length, length) + np.arange(total)] if total else np.empty(0, self.typed), upto

    def encode(self, texts: pa.Array, end: int | None = END) -> pa.Array:
        """The ids of each text with the end id behind them, as bytes."""
        last = np.array([] if end is None else [end], self.typed)
        lists = [t or "" for t in texts.to_pylist()] if not self.by_words or pa.compute.any(pa.compute.match_substring(texts, "<|")).as_py() else None
        if lists is not None:
            out: list[bytes] = []
            for t in lists:
                if not self.by_words:
                    out.append(self._whole(t) + last.tobytes())
                    continue
                if "<|" not in t:
                    out += self.encode(pa.array([t]), end).to_pylist()
                    continue
                words = t.encode("utf-8").split()
                distinct = list(dict.fromkeys(words))
                numbers = dict(zip(distinct, self._numbers(distinct).tolist()))
                out.append(self._ids(np.array([numbers[w] for w in words], np.int64))[0].tobytes() + last.tobytes())
            return pa.array(out, pa.binary())
        texts = pa.compute.fill_null(texts, "")
        _, where, data = texts.buffers()
        offsets = np.frombuffer(where, np.int32, len(texts) + 1, texts.offset * 4)
        raw = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if data and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        starts = (offsets[:-1] - offsets[0]).astype(np.int64)
        kind = np.frombuffer(raw.tobytes().translate(_KIND), np.uint8)
        behind = kind[:-1] & _LETTER  # 1: the byte ends a letter
        behind[1:] |= (kind[:-2] >> 3) & (kind[1:-1] >> 2)
        marks = np.flatnonzero(behind & (kind[1:] >> 1)) + 1
        # white space before each such mark and before each text
        parted = np.insert(raw, np.concatenate([starts, marks]), 32).tobytes().translate(_LOWER)
        starts = starts + np.arange(len(starts)) + np.searchsorted(marks, starts)
        solid = np.frombuffer(parted, np.uint8) != 32
        turns = np.flatnonzero(solid[1:] != solid[:-1]) + 1  # the first byte is white space
        begin, stop = turns[::2], turns[1::2] if len(turns) % 2 == 0 else np.append(turns[1::2], len(solid))
        if len(begin):
            held = np.concatenate([[0], np.cumsum(stop - begin)]).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(held), pa.py_buffer(parted.translate(None, b" "))]).dictionary_encode()
            ids, upto = self._ids(self._numbers(words.dictionary.to_pylist())[words.indices.to_numpy()])
        else:
            ids, upto = np.empty(0, self.typed), np.empty(0, np.int64)
        closes = np.concatenate([[0], upto])[np.searchsorted(begin, np.concatenate([starts[1:], [len(parted)]]))]
        if end is not None:
            ids = np.insert(ids, closes, end)
            closes = closes + np.arange(1, len(closes) + 1)
        held = np.concatenate([[0], closes * self.typed.itemsize]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(held), pa.py_buffer(np.ascontiguousarray(ids))])

    def __call__(self, texts: list[str | None], end: int | None = END) -> list[bytes]:
        return self.encode(pa.array(texts, pa.string()), end).to_pylist()


def _storage(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder that all executors share: local paths and whatever pyarrow knows (s3, gs, hdfs, ...)."""
    local = re.fullmatch(r"(?:file:/*)?(/.*|[^/:]+/.*)", folder)
    if local and not re.match(r"[a-z0-9]+://", folder.replace("file://", "")):
        return pa.fs.LocalFileSystem(), "/" + local[1].lstrip("/") if folder.startswith("file:") else local[1]
    return pa.fs.FileSystem.from_uri(folder)


def file_schema(typed: np.dtype, length: int = LENGTH) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(typed), length)), ("mask", pa.list_(pa.bool_(), length)),
                      ("ends", pa.list_(pa.bool_(), length)), ("docs", pa.list_(pa.int64()))], {"end_id": str(END), "length": str(length)})


class TokenFileWriter:
    """Writes one file: documents in, batches of full sequences out. The file gets its name when it is complete, so a task that runs twice does no harm."""

    def __init__(self, folder: str, name: str, typed: np.dtype, length: int = LENGTH):
        self.fs, base = _storage(folder)
        self.path, self.draft = f"{base}/{name}", f"{base}/_{name}.{uuid.uuid4().hex}"
        self.name, self.typed, self.length, self.schema = name, typed, length, file_schema(typed, length)
        self.fs.create_dir(base, recursive=True)
        self.sink = self.fs.open_output_stream(self.draft)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.rest, self.total, self.docs, self.ids = [], 0, 0, 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        x = np.frombuffer(ids, self.typed)
        self.held.append(x)
        self.rest, self.total, self.docs = self.rest + len(x), self.total + len(x), self.docs + 1
        self.ids.append((doc_id, self.total - 1))  # where its last id stands
        if self.rest >= BATCH * self.length:
            self._flush(False)

    def _flush(self, close: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.typed)
        full = -(-len(ids) // self.length) if close else len(ids) // self.length // BATCH * BATCH
        start, size = self.total - len(ids), full * self.length
        mask, ends = np.zeros(size, bool), np.zeros(size, bool)
        mask[: min(size, len(ids))] = True
        here = [(d, e) for d, e in self.ids if e < start + size]
        self.ids = self.ids[len(here):]
        at = np.array([e - start for _, e in here], np.int64)
        ends[at] = True
        out = np.zeros(size, self.typed)
        out[: min(size, len(ids))] = ids[:size]
        offsets = np.concatenate(([0], np.cumsum(np.bincount(at // self.length, minlength=full)[:full]))).astype(np.int32)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (out, mask, ends)]
        lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array([d for d, _ in here], pa.int64())))
        batch = pa.RecordBatch.from_arrays(lists, schema=self.schema)
        for a in range(0, full, BATCH):
            self.writer.write_batch(batch.slice(a, BATCH))
        self.held = [ids[size:]] if len(ids) > size else []
        self.rest = max(0, len(ids) - size)

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.sink.close()
        self.fs.move(self.draft, self.path)


class TokenFile:
    """A file by row: ``file[i]`` gives ids and mask of sequence i as views of the mapped file."""

    def __init__(self, folder: str, name: str):
        fs, base = _storage(folder)
        path = f"{base}/{name}"
        source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = int(self.reader.schema.metadata[b"length"])

    def batches(self):
        return (self.reader.get_batch(i) for i in range(self.reader.num_record_batches))

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        batch = self.reader.get_batch(i // BATCH)  # all batches but the last have BATCH rows
        ids, mask = batch.column(0), batch.column(1)
        k = (i % BATCH) * self.length
        return ids.values.slice(k, self.length).to_numpy(zero_copy_only=True), mask.values.slice(k, self.length)

    def documents(self):
        """(doc_id, ids as unsigned 32-bit) of each document, in the order of the file."""
        held = []
        for batch in self.batches():
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            ends = np.flatnonzero(batch.column(2).flatten().to_numpy(zero_copy_only=False))
            docs = batch.column(3).flatten().to_pylist()
            start = 0
            for d, e in zip(docs, ends.tolist()):
                held.append(ids[start: e + 1])
                yield d, np.concatenate(held).astype("<u4")
                held, start = [], e + 1
            held.append(ids[start:])


def write_token_files(df: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", spec: str | None = None) -> DataFrame:
    """Encode every text and write the files under ``folder``; returns what was written: ``block part name n_docs n_ids start``.

    Documents go to ranges of ids in one shuffle of their ids, each range streams to its files. ``start`` counts the ids in all files before. Null ids come first,
    rows of one id follow by their tokens, repeats are rows like others; a null or empty text has the end id only. No rows: no files.
    """
    spec = spec or tokenizer_json()
    typed = WordEncoder(spec).typed
    keyed, n = id_ranges(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("_key"), F.col(text).alias("_text")), "_key")

    def make():
        own = worker_state(("words", spec), lambda: WordEncoder(spec))
        return lambda texts: [own.encode(texts)]

    dealt = map_texts(keyed, ["doc_id", "_key", "_block"], "_text", make, "ids binary", arrow=True, join=True).repartitionById(n, "_block")
    dealt = dealt.sortWithinPartitions("_key", "ids").select("_block", "doc_id", "ids")

    def write(batches):
        file, part, out = None, 0, []
        for b in batches:
            for block, d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if file is None:
                    file = TokenFileWriter(folder, f"{block:07d}-{part:05d}.arrow", typed)
                file.add(d, ids)
                if file.total >= FILE_IDS:
                    file.close()
                    out.append((block, part, file.name, file.docs, file.total))
                    file, part = None, part + 1
        if file is not None:
            file.close()
            out.append((block, part, file.name, file.docs, file.total))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                                             ["block", "part", "name", "n_docs", "n_ids"])

    files = settle(dealt.mapInArrow(tidy(write), "block int, part int, name string, n_docs long, n_ids long"))
    before = Window.orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return settle(files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id start n_tokens ids_crc32`` of every document in the files, read again from them."""
    def run(batches):
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = []
                for d, ids in TokenFile(folder, name).documents():
                    out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(out) == 8192:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.select("name", "start").repartition(partitions_of(files.sparkSession))
    return spread.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(df: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: str | None = None) -> DataFrame:
    """Write the files of ``df`` to a new folder under the shared checkpoint folder and read them back."""
    folder = f"{checkpoint_dir(df.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(df, folder, doc_id, text, spec), folder)
