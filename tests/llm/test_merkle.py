import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tidewright.llm import merkle as M

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, fanout):
    """(root, siblings of each digest as levels of (left, right)), by lists."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, p in enumerate(at):
            run = digests[p // fanout * fanout: p // fanout * fanout + fanout]
            paths[i].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1:])))
        digests = [H("".join(digests[i: i + fanout])) for i in range(0, len(digests), fanout)]
        at = [p // fanout for p in at]
    return digests[0], paths


def folded(own, path):
    for left, right in path:
        own = H(left + own + right)
    return own


def by_hand(rows, fanout=M.FANOUT):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    trees = {g: tree([x for x, _ in groups[g]], fanout) for g in names}
    root, tops = tree([trees[g][0] for g in names], fanout) if names else (None, [])
    for top, g in zip(tops, names):
        for (own, r), path in zip(groups[g], trees[g][1]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            other = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if tampered else own
            end = folded(other, path + top)
            yield (r[0], own, trees[g][0], root, H("".join(a + b for a, b in path + top)), end, end == root)


def same(df, rows):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, M.tamper_proof(df).collect()), key=key) == sorted(by_hand(rows), key=key)


def test_documents_and_odd_rows(spark, small, odd, nothing):
    for df in (spark.read.parquet(f"{small}/documents.parquet"), odd):
        same(df, [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert M.tamper_proof(nothing).count() == 0


def test_trees_of_all_sizes(spark):
    """Around powers of the fanout, a group of a single row, more groups than a run holds, a third of the rows without an id."""
    rnd, rows = random.Random(2), []
    for g, n in enumerate([1, 2, 15, 16, 17, 31, 32, 33, 255, 256, 257, 300, *[1] * 9]):
        rows += [(rnd.choice([None, rnd.randrange(10**6), rnd.randrange(20)]), f"g{g}", None, i, rnd.choice(["Ab", "ab", None, "", "É X"])) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    same(df, rows)
    assert M.manifest(df, FIELDS).select("root").distinct().count() == 1


def test_any_change_breaks_the_fold(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = M.manifest(docs, FIELDS, changed={"lang": F.when(F.col("doc_id") == 7, "xx").otherwise(F.col("lang"))}, fanout=3)
    good = out.where(M.fold(F.col("claimed"), F.col("path")) == F.col("root"))
    assert {r[0] for r in out.select("doc_id").collect()} - {r[0] for r in good.select("doc_id").collect()} == {7}
    # one changed row changes the root and its own group's subroot, no other
    other = M.manifest(docs.withColumn("lang", F.when(F.col("doc_id") == 7, "xx").otherwise(F.col("lang"))), FIELDS)
    a = {r["doc_id"]: r for r in M.manifest(docs, FIELDS).collect()}
    for r in other.collect():
        assert r["root"] != a[r["doc_id"]]["root"]
    moved = {i for i, r in ((r["doc_id"], r) for r in other.collect()) if r["subroot"] != a[i]["subroot"]}
    assert moved == {r["doc_id"] for r in docs.collect() if r["source"] == next(x["source"] for x in docs.collect() if x["doc_id"] == 7)}
