import itertools
import random
import zlib

import numpy as np
import pytest

from tidewright.llm.nbest import Segmenter, encode_nbest, model_bytes, nbest_digests


@pytest.fixture(scope="module")
def seg():
    return Segmenter(model_bytes())


def every_cost(seg, word):
    """Costs of all segmentations of a word."""
    edges, _ = seg.lattice(word.replace(" ", "▁"))

    def upto(end):
        if end == 0:
            return [0]
        return [c + cost for start, (_, cost) in edges[end] for c in upto(start)]
    return sorted(upto(len(word)))


def test_paths_are_the_cheapest_of_all(seg):
    for w in [" thanedble", " a", " ", "   x", " été", "\n", "漢字kanji", " x\udbffy", " internat"]:
        costs = every_cost(seg, w)
        for n in (1, 2, 5, 50):
            got = seg.paths(w, n)
            assert [c for c, _ in got] == costs[:n] and len({p for _, p in got}) == len(got)
        cost, ids, gap = seg.best_of(w)
        assert cost == costs[0] and (gap == costs[1] - costs[0] if len(costs) > 1 else gap == 1 << 60)
        assert np.frombuffer(ids, seg.typed).tolist() == list(seg.paths(w, 1)[0][1]) or every_cost(seg, w).count(cost) > 1


def test_best_of_a_text_are_the_best_sums(seg):
    rnd = random.Random(2)
    for _ in range(30):
        words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 5))) for _ in range(4)]
        text = " ".join(words)
        sums = sorted(map(sum, itertools.product(*(every_cost(seg, w) for w in seg.words(text)))))
        got = seg.encode(text, 6)
        assert [c for c, _ in got] == sums[: len(got)] and len(got) == min(6, len(sums))
        assert len({tuple(x.tolist()) for _, x in got}) == len(got)


def test_exact_round_trip(seg, spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for t in texts[:60] + ["a", " a  b ", "\n\n x", "▁x▁ y", "日本語\t", "a\n b", "  ", "\x00", "\U0001f600", "x" * 5000]:
        for _, ids in seg.encode(t, 3):
            assert seg.decode(ids) == t


def test_tables(seg, spark, odd, nothing):
    got = nbest_digests(odd).collect()
    assert len(got) == odd.count() and all(r["exact"] for r in got)
    texts = {(r["doc_id"], len(r["text"] or "")): r["text"] for r in odd.collect()}
    for r in got:
        ids = seg.encode(texts[r["doc_id"], r["n_chars"]], 4)
        assert r["n_tokens"] == len(ids[0][1]) == r["lengths"][0] and r["ids_crc32"] == zlib.crc32(ids[0][1].astype("<u4").tobytes())
        assert r["scores"] == [-c / 1e6 for c, _ in ids] and r["lengths"] == [len(x) for _, x in ids]
    for r in encode_nbest(odd, ["doc_id", "text", "size"]).collect():
        ways = seg.encode(r["text"], 4)
        assert r["ids"] == ways[0][1].tolist() and len(r["alternatives"]) == len(ways) - 1
        for alt in r["alternatives"]:
            ids = list(r["ids"])
            for c in reversed(alt["changes"]):
                ids[c["at"]: c["at"] + c["n"]] = c["ids"]
            assert seg.decode(ids) == (r["text"] or "") and any(ids == x.tolist() for _, x in ways)
    assert encode_nbest(nothing, ["doc_id"]).count() == 0 and nbest_digests(nothing).count() == 0
