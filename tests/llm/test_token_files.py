import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tidewright.llm import token_files as T
from tidewright.llm.common import joined


def by_hand(rows):
    tokenizer, start = Tokenizer.from_str(T.tokenizer_json()), 0
    coded = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    for i, ids in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes())):
        yield i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_round_trip(spark, small, odd, nothing):
    for df in (spark.read.parquet(f"{small}/documents.parquet"), odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        assert sorted(map(tuple, T.token_round_trip(df).collect()), key=str) == sorted(by_hand(rows), key=str)
    assert T.token_round_trip(nothing).count() == 0


def test_words_by_themselves_encode_as_whole_texts():
    encoder = T.WordEncoder(T.tokenizer_json())
    for t in ["á ́b c̈\x0b\x1cD", "ΑΣ Σ.", "x　y\xa0z <|endoftext|>", "'s it's 12.5%", "ﬁ ½ İstanbul", "\x85 a", "Don't stop: IT'S x² a.b,c É,é' ÷! a<|endoftext|>.b <|ENDOFTEXT|>", "K\u0301. \u212a! e\u0301, ...a... ***b***", None, "", "  "]:
        want = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(encoder([t])[0], encoder.typed).tolist() == want


def test_sequences_by_number_without_copies(tmp_path):
    rng = np.random.default_rng(0)
    docs = [(i if i else None, rng.integers(0, 40_000, n, dtype=np.uint16)) for i, n in enumerate([1, 5, 8, 9, 0, 3 * 8, 8 * T.BATCH * 2 + 3, 7])]
    w = T.TokenFileWriter(str(tmp_path), "x.arrow", np.dtype("<u2"), length=8)
    for i, x in docs:
        w.add(i, np.append(x, 1).astype("<u2").tobytes())
    w.close()
    whole = np.concatenate([np.append(x, 1) for _, x in docs])
    f = T.TokenFile(str(tmp_path), "x.arrow")
    before = pa.total_allocated_bytes()
    for k in range(-(-len(whole) // 8)):
        ids, mask = f[k]
        n = min(8, len(whole) - 8 * k)
        assert ids[:n].tolist() == whole[8 * k: 8 * k + n].tolist() and mask.to_pylist() == [True] * n + [False] * (8 - n)
    assert pa.total_allocated_bytes() == before
    got = list(f.documents())
    assert [d for d, _ in got] == [d for d, _ in docs] and all(g.tolist() == np.append(x, 1).tolist() for (_, g), (_, x) in zip(got, docs))
    assert [p.name for p in tmp_path.iterdir()] == ["x.arrow"]


def test_folders():
    for url, path in (("file:/a/b", "/a/b"), ("file:///a/b", "/a/b"), ("/a/b", "/a/b")):
        assert T._storage(url)[1] == path


def test_words_of_letters_are_told_apart_by_their_last_ids():
    encoder, plain = T.WordEncoder(T.tokenizer_json()), T.WordEncoder(T.tokenizer_json())
    plain.closing = None
    words = ["th", "onorresh", "Thing", "\u00e9t\u00e9", "\u00c9te", "\u00e0\u00ff", "a\u00d7b", "\u00f7", "it's", "96.203", ",", "\u03b1\u03b2", "\u3042"] + ["w" + str(n).translate(str.maketrans("0123456789", "tehaonrisd")) for n in range(9000)]
    others = encoder._learn_letters([w.encode() for w in words])
    assert [w.decode() for w in others] == ["Thing", "a\u00d7b", "\u00f7", "it's", "96.203", ",", "\u03b1\u03b2", "\u3042"]
    known = list(encoder.known)
    plain._learn(known)
    numbers = [np.array(list(map(e.known.get, known)), np.int64) for e in (encoder, plain)]
    for a, b in zip(encoder._ids(numbers[0]), plain._ids(numbers[1])):
        assert a.tolist() == b.tolist()
    encoder.closing[:] = False  # marks that don't fit the words: none is learnt from them
    assert encoder._learn_letters([b"some", b"words"]) == [b"some", b"words"]


def test_small_batches_are_put_together():
    batches = [pa.record_batch({"t": pa.array(["x" * n] * 2), "i": pa.array([n, n])}) for n in (10, 20, 500, 1, 2, 3)]
    got = list(joined(iter(batches), "t", 120))
    assert [b.num_rows for b in got] == [4, 2, 6] and pa.Table.from_batches(got).equals(pa.Table.from_batches(batches).combine_chunks())
