import hashlib

from tests.llm.conftest import same_rows
from tidewright.llm.queries import SQL
from tidewright.llm.sharding import shard, write_shards


def by_hand(rows, limit):
    """Split buckets bit by bit."""
    keyed = [(i, n, int(hashlib.md5((str(i) if i is not None else "-").encode()).hexdigest()[:15], 16)) for i, n in rows]
    out = []

    def place(bits, some):
        total = sum(n for _, n, _ in some)
        if total <= limit or len({h for _, _, h in some}) < 2:
            out.extend((i, n, bits or "*", len(bits), total, len(some)) for i, n, _ in some)
            return
        for b in "01":
            half = [r for r in some if format(r[2], "060b")[len(bits)] == b]
            if half:
                place(bits + b, half)
    place("", keyed)
    return sorted(out, key=str)


def test_only_oversized_buckets_split(spark, small):
    docs = spark.read.parquet(f"{small}/../sf0.01/documents.parquet")
    rows = [(r["doc_id"], len((r["text"] or "").encode())) for r in docs.collect()]
    for limit in (1000, 30_000, 400_000, 1 << 30):
        got = shard(docs, limit=limit)
        assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows, limit)


def test_sql_with_a_small_limit(spark, small, con):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert same_rows(shard(docs, limit=50_000), con.execute(SQL["op8_extendible_shards"].replace("16777216", "50000"))) == docs.count()


def test_odd_rows(spark, odd, nothing, tmp_path):
    rows = [(r["doc_id"], len((r["text"] or "").encode())) for r in odd.collect()]
    for limit in (5, 100):
        assert sorted(map(tuple, shard(odd, limit=limit).collect()), key=str) == by_hand(rows, limit)
    assert shard(nothing).count() == 0
    written = write_shards(odd.drop("shard"), str(tmp_path / "out"), limit=100)
    assert sum(r["docs"] for r in written.collect()) == odd.count()
