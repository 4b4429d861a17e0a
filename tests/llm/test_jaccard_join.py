import random

import pytest

from tidewright.llm import jaccard_join as J
from tidewright.llm.components import components


def by_hand(rows, percent=80, width=5):
    """Every pair compared with sets of word tuples."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i: i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    low = {}
    for a, (i, _) in enumerate(rows):
        r = find(a)
        low[r] = i if low.get(r) is None else low[r] if i is None else min(low[r], i)
    return sorted(((i, len(sets[a]), low[find(a)] if sets[a] else i, links[a]) for a, (i, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def copies():
    """A large group of near copies of one text, some of exact ones, unlike texts with a common passage, short texts."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base, passage, rows = [word() for _ in range(60)], [word() for _ in range(30)], []
    for i in range(260):
        t = list(base)
        for _ in range(rnd.choice((0, 1, 1, 2, 3))):
            t[rnd.randrange(60)] = word()
        rows.append((i, " ".join(t)))
    for i in range(260, 330):
        rows.append((i, " ".join([word() for _ in range(rnd.choice((2, 5, 9, 40)))] + passage + [word() for _ in range(rnd.choice((0, 3, 30)))])))
    rows += [(330 + i, " ".join(base[: 1 + i % 7])) for i in range(30)] + [(400 + i, rows[i % 3][1].upper()) for i in range(30)]
    rnd.shuffle(rows)
    return rows


def test_groups_equal_all_pairs(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df).collect()), key=str) == by_hand(copies)


def test_large_groups_go_to_tiles(spark, copies, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_DOCS", 20)
    df = spark.createDataFrame(copies, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df).collect()), key=str) == by_hand(copies)


def test_prefixes_are_long_enough():
    for n in range(1, 400):
        p = J.prefix_size(n, 80)
        need = -(-80 * n // 100)
        assert p == n - need + 1


def test_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, J.jaccard_components(odd).collect()), key=str) == by_hand(rows)
    assert J.jaccard_components(nothing).count() == 0


@pytest.mark.parametrize("small_table", [J.SMALL_TABLE, 0])
def test_null_and_repeated_ids_read_each_text_once_more(spark, monkeypatch, small_table):
    """Texts of classes without an id of their own are found by digest, not by pairing all rows of one id with all such classes."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(120):
        base = [word() for _ in range(40)]
        ids = [(None, None), (None, 7), (7, 7), (1000 + i, None), (2000 + i, 3000 + i)][i % 5]
        rows += [(ids[0], " ".join(base)), (ids[1], " ".join([*base, word()]))] + [(ids[0], " ".join(base))] * (i % 10 == 0)
    read, inner = [], J.map_texts

    def counted(df, keep, *a):
        read.append(df.count())
        return inner(df, keep, *a)
    monkeypatch.setattr(J, "map_texts", counted)
    monkeypatch.setattr(J, "SMALL_TABLE", small_table)
    if not small_table:
        monkeypatch.setattr(J, "_frequent", lambda *a: J.np.empty(0, J.np.uint64))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df).collect()), key=str) == by_hand(rows)
    assert sum(read) <= 3 * len(rows)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (200, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {300: 200}
