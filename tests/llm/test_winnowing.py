import hashlib
import random

import numpy as np

from tidewright.llm import winnowing as W


def slow(text, k, w):
    """Positions by looking at every window."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    k = min(k, len(codes))
    h = [int(W.gram_hashes(codes[i: i + k], k)[0]) for i in range(len(codes) - k + 1)]
    out = set()
    for a in range(max(1, len(h) - w + 1)):
        part = h[a: a + w]
        out.add(a + max(i for i, x in enumerate(part) if x == min(part)))
    return [(h[p], p) for p in sorted(out)]


def test_same_as_every_window_by_hand(monkeypatch):
    rnd = random.Random(3)
    for n in (1, 5, 15, 16, 17, 46, 47, 48, 300, 2000):
        for letters in ("ab", "abcdefgh é漢😀", "a"):
            t = "".join(rnd.choice(letters) for _ in range(n))
            h, p = W.winnow(t)
            assert list(zip(h.tolist(), p.tolist())) == slow(t, W.GRAM, W.WINDOW)
    t = "".join(rnd.choice("abcdef ") for _ in range(3000))
    whole = [x.tolist() for x in W.winnow(t)]
    monkeypatch.setattr(W, "PIECE", 200)
    assert [x.tolist() for x in W.winnow(t)] == whole


def test_common_runs_are_noticed():
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    for _ in range(200):
        run = word(W.GRAM + W.WINDOW - 1)
        a, b = word(rnd.randrange(200)) + run + word(rnd.randrange(200)), word(rnd.randrange(200)) + run + word(rnd.randrange(200))
        assert set(W.winnow(a)[0].tolist()) & set(W.winnow(b)[0].tolist())


def by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        e = W.edited(t, after)
        f, g, n = W.winnow(t), W.winnow(e), W.winnow(after)
        sets = [np.unique(x[0]) for x in (f, g, n)]
        yield (i, len(t), hashlib.sha256(e.encode()).hexdigest(), W.as_string(*f), W.as_string(*g), W.likeness(sets[0], sets[1]), W.likeness(sets[0], sets[2]))


def test_documents(spark, small, odd, nothing):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    key = lambda r: tuple(map(str, r))
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        assert sorted(map(tuple, W.fingerprints(df).collect()), key=key) == sorted(by_hand(rows), key=key)
    assert W.fingerprints(nothing).count() == 0
    one = W.fingerprints(docs.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
