import hashlib
import random
import re
import time

from tidewright.llm import wu_manber as W

BENCH = "item_id long, text string"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(text, items, window=W.WINDOW):
    """Every window of every item at every place."""
    words, hit, names = plain_words(text), set(), set()
    for name, t in items:
        own = plain_words(t)
        size = min(window, len(own))
        wins = {tuple(own[i: i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1) if size else ():
            if tuple(words[i: i + size]) in wins:
                hit |= set(range(i, i + size))
                names.add("" if name is None else str(name))
    ids = sorted(names)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def test_search_equals_brute_force():
    rnd = random.Random(4)
    for letters, window in (("ab", 10), ("ab", 3), ("abc", 2), ("abcdefgh", 10), ("abcdefgh", 4), ("ab", 1), ("a", 10)):
        for _ in range(60):
            items = [(i, " ".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 30])))) for i in range(rnd.randrange(1, 7))]
            text = " ".join(rnd.choice(letters) for _ in range(rnd.randrange(80)))
            if rnd.random() < 0.5:
                text += " " + rnd.choice(items)[1] + " c"
            spans, names = W.Finder([(str(i), W.words_of(t)) for i, t in items], window)(W.words_of(text))
            n, hit, k, _, _ = by_hand(text, items, window)
            assert (len(W.words_of(text)), sum(b - a for a, b in spans), len(names)) == (n, hit, k), (items, text, window)
            assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_positions_are_skipped():
    find = W.Finder([("1", W.words_of("one two three four five six seven eight nine ten eleven"))])
    (search,) = find.searches
    assert search.most == 9 and search.shift[(b"nine", b"ten")] == 0 and search.shift[(b"one", b"two")] == 8 and (b"two", b"one") not in search.shift


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r)))


def test_documents_and_odd_rows(spark, small, odd, nothing):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    more = spark.createDataFrame([(1, "The quick BROWN fox"), (1, "over the lazy"), (None, "two words"), (None, None), (3, ""), (4, " -- "), (5, "one"),
                                  (6, "the quick brown fox jumps over the lazy dog"), (6, "the quick brown fox jumps over the lazy dog"), (7, "É́")], BENCH)
    empty = spark.createDataFrame([], BENCH)
    for docs, bench in ((spark.read.parquet(f"{small}/documents.parquet"), items), (odd, more), (odd, empty), (odd, items)):
        want = [(r["doc_id"], *by_hand(r["text"], [(i["item_id"], i["text"]) for i in bench.collect()])) for r in docs.collect()]
        assert rows_of(W.contamination(docs, bench)) == sorted(want, key=lambda r: tuple(map(str, r)))
    assert W.contamination(nothing, more).count() == 0 and W.contamination(nothing, empty).count() == 0


def test_many_parts_find_the_same(spark, small, odd):
    """Items cut into pieces and parts: long items keep every window, rows found in several parts are merged."""
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    long = [" ".join(rnd.choice(vocabulary) for _ in range(3000)) for _ in range(4)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(long)] + [(9, "two words"), (8, "quick brown fox"), (7, "brown fox jumps")], BENCH)
    docs = spark.createDataFrame([(i, " ".join(long[i % 4].split()[i * 37: i * 37 + 400]) + " x " + " ".join(long[3].split()[5:18])) for i in range(60)], "doc_id long, text string")
    old, W.PIECE_BYTES = W.PIECE_BYTES, 2000
    try:
        for d in (docs, odd):
            one, many = W.find_passages(d, bench, ["doc_id"]), W.find_passages(d, bench, ["doc_id"], part_bytes=9000)
            assert len(W.item_parts(bench, "item_id", "text", W.WINDOW, 9000)) > 3
            assert rows_of(one) == rows_of(many)
    finally:
        W.PIECE_BYTES = old


def test_long_and_repetitive_texts_take_linear_time():
    items = [(str(k), W.words_of(t)) for k, t in enumerate(["a " * 40, "a " * 9 + "b", "a a", "b", "x " * 9 + "y"])]
    find, took = W.Finder(items), []
    for n in (100_000, 400_000):
        t = time.process_time()
        spans, names = find([b"a"] * n)
        took.append(time.process_time() - t)
        assert spans == [(0, n)] and names == {"0", "2"}
    assert took[1] < 12 * took[0] + 0.2
