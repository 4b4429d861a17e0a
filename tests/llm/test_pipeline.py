import corpus_pipeline as P
from tests.llm.test_jaccard_join import by_hand
from tidewright.llm import mixing, nbest


def test_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = P.settle(P.quality(spark, docs, small))
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    clean = {i for i, r in labels.items() if r["quality"] == 1 and not r["toxic"]}
    poor = {i for i, r in labels.items() if r["quality"] == 0 or r["toxic"] == 1}
    assert len(clean & kept) >= 0.98 * len(clean) and len(poor & kept) <= 0.05 * len(poor)

    single = P.settle(P.near_copies(spark, good, small))
    want = {r[0] for r in by_hand([(i, before[i]["text"]) for i in sorted(kept)]) if r[0] == r[2]}
    rows = single.collect()
    assert single.columns == docs.columns and len(rows) == len(want) and {r["doc_id"] for r in rows} == want

    mixed = P.settle(P.mixture(spark, single, small))
    copies = mixing.mix(single.withColumn("w", mixing.word_count("text")), size="w").collect()
    assert mixed.columns == docs.columns and mixed.count() == sum(r["_copies"] for r in copies)
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in copies if r["_copies"]}

    seg, out = nbest.Segmenter(nbest.model_bytes()), P.pieces(spark, mixed, small).collect()
    assert len(out) == mixed.count() and all(seg.decode(r["ids"]) == before[r["doc_id"]]["text"] for r in out)
    assert sorted(r["doc_id"] for r in P.run(spark, small).collect()) == sorted(r["doc_id"] for r in out)


def test_odd_and_empty_tables(spark, odd, nothing, small):
    for df in (odd, nothing):
        for _, stage in P.STAGES[:-1]:
            out = P.settle(stage(spark, df, small))
            assert out.columns == df.columns and out.count() <= 2 * df.count()
        assert P.pieces(spark, df, small).count() == df.count()
    rows = P.near_copies(spark, odd, small).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 1 and sum(r["doc_id"] is None for r in rows) == 1 and sum(r["doc_id"] == 5 for r in rows) == 2


def test_copies_are_told_apart_by_id_and_text(spark):
    """A third of the rows lacks an id, and one id stands on unlike texts: each distinct text stays once, in its row of the smallest id."""
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)]
    rows = [(i, texts[i]) for i in range(4)] + [(None, texts[i]) for i in range(3, 8)] * 2 + [(0, texts[9]), (7, texts[9]), (7, texts[10]), (7, texts[10])]
    rows += [(3, texts[11]), (None, None), (None, ""), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(P.near_copies(spark, docs, "").collect(), key=lambda r: (r["text"] or "", str(r["doc_id"])))
    want = [(0, texts[9]), (7, texts[10]), (3, texts[11])] + [(i, texts[i]) for i in range(4)] + [(None, texts[i]) for i in range(4, 8)]
    assert sorted(((r["doc_id"], r["text"]) for r in got if r["text"]), key=str) == sorted(want, key=str)
    assert [r["doc_id"] for r in got if not r["text"]].count(9) == 1 and sum(not r["text"] for r in got) == 3
