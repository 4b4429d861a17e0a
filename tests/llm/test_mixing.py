from collections import defaultdict

from pyspark.sql import functions as F

from tidewright.llm.mixing import fill_targets, mix, repeat_rows, word_count


def shared_out(sizes, weights, share, limit):
    """Targets by sharing the excess again until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, done = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in done]
        level = left / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if w[s] * level >= limit * sizes[s]]
        if not over:
            return done | {s: w[s] * level for s in rest}
        for s in over:
            done[s] = limit * sizes[s]
            left -= done[s]


def test_targets_match_repeated_sharing(spark):
    sizes = {"a": 5000, "b": 100, "c": 10, None: 70, "": 0, "Ä": 900, "z": 400}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["_target"] for r in fill_targets(df, "source", "size", (3, 1, 2), 1.5, 2.0).collect()}
    want = shared_out(sizes, (3, 1, 2), 1.5, 2.0)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_words_taken_are_near_targets_and_reruns_agree(spark, small):
    docs = spark.read.parquet(f"{small}/../sf0.01/documents.parquet").select("doc_id", "source", word_count("text").alias("size"))
    rows = mix(docs).collect()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert 0 <= r["_copies"] <= 2
        taken[r["source"]] += r["_copies"] * r["size"]
        target[r["source"]] = r["_target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= 1.5 * largest[s]
    assert abs(sum(taken.values()) - sum(target.values())) < 0.03 * sum(target.values())
    again = mix(docs.repartition(5)).collect()
    assert {r["doc_id"]: r["_copies"] for r in rows} == {r["doc_id"]: r["_copies"] for r in again}


def test_odd_rows(spark, odd, nothing):
    out = mix(odd.withColumn("size", word_count("text")))
    assert out.count() == odd.count() and set(odd.columns) < set(out.columns)
    assert {r["source"]: r["_source_size"] for r in out.collect()}[None] == 0
    assert mix(nothing.withColumn("size", word_count("text"))).count() == 0
    picked = repeat_rows(out)
    assert picked.columns == odd.columns and picked.count() == out.agg(F.sum("_copies")).first()[0]
