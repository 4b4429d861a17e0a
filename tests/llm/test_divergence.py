import random
import re
from collections import Counter, defaultdict

from tidewright.llm import divergence as D

ROWS = "doc_id long, text string, lang string, source string"


def by_hand(rows, top=200):
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((t or "", a or "", s or "") for t, a, s in rows):
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    for lang in {a for a, _ in count}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        sources = [s for a, s in count if a == lang]
        own = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        p, q = {s: share(own[s]) for s in sources}, share(whole)
        gap = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-gap(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                yield from ((lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found))


def same(df, rows):
    got = sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == sorted(by_hand(rows)) and got == sorted(set(got))
    return got


def test_documents_and_odd_rows(spark, small, odd, nothing):
    for df in (spark.read.parquet(f"{small}/documents.parquet"), odd):
        assert same(D.audit(df), [tuple(r) for r in df.select("text", "lang", "source").collect()])
    assert D.audit(nothing).count() == 0


def test_cells_of_many_sources_and_terms(spark, monkeypatch):
    """More sources than a block, more terms than a block, a source with most rows, one without terms, a language of which no term is kept, flushes amid a task."""
    rnd = random.Random(8)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "abcdefghijkl"] + ["é", "ÉÀ", "漢"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(40))), rnd.choice(["en", "de"]), rnd.choice(["hot", f"s{rnd.randrange(12)}"])) for i in range(400)]
    rows += [(1, "1 2 3", "en", "bare"), (2, None, "xx", "a"), (3, "only here", "xx", "b"), (4, "A-b_C\x00d", None, None)] + [(5, "t" * 5000 + " t", "en", "s1")] * 3
    df = spark.createDataFrame(rows, ROWS)
    plain = [(t, a, s) for _, t, a, s in rows]
    same(D.audit(df), plain)
    for name, value in (("BLOCK", 3), ("TERMS", 16), ("HELD", 50), ("FEW_GROUPS", 2)):
        monkeypatch.setattr(D, name, value)
    heads = {r[:4] for r in same(D.audit(df), plain) if r[2] == "pair"}
    assert ("xx", "a", "pair", "b") in heads and ("en", "bare", "pair", "hot") in heads


def test_shares_are_exact_for_large_counts(spark):
    rows = [(n, 10**15, v) for n in (0, 1, 7, 10**9, 123_456_789_012, 10**15 - 1) for v in (1, 3, 10**6 + 3)]
    df = spark.createDataFrame(rows, "n long, total long, terms long").withColumn("p", D._scaled("n", "total", "terms"))
    for r in df.collect():
        assert r["p"] == 1 + 10**9 * (r["n"] + 1) // (r["total"] + r["terms"])
