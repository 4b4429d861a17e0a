import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidewright.llm import licences as L


def by_hand(text):
    """Words and base phrases, place by place."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i: i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = ["Released under the MIT License.", "x Apache License, Version 2.0 y apache license version 2", "CC-BY-NC 4.0; cc by nc cc by nc", "MIT", "", None, "É CC BY NCX", "ccbync",
         "SPDX-License-Identifier: GPL-3.0", "Permission is hereby granted, free of charge, to any person obtaining a copy", "licensed under CC BY-NC-SA 4.0", "x" * 100_000 + " cc by nc"]


def test_base_places(spark, small):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for t in texts:
        got = L.scan_text(t)
        assert got[:5] == by_hand(t) and set(filter(None, got[4].split(","))) <= set(filter(None, got[5].split(","))) and 0 <= got[6] <= 1
    assert any(by_hand(t)[1] for t in texts[len(TEXTS):])


def test_rules_and_suppression():
    assert len(L.rules()[0]) > 200
    # the longer name inside stronger wording wins; what it covers is gone
    assert [d[4] for d in L.detections("licensed under cc by nc sa 4 0")] == ["cc-by-nc-sa"]
    assert [d[4] for d in L.detections("spdx license identifier gpl 3 0")] == ["gpl-3"]
    assert L.detections("the gplx and mitten licences of a limit") == []
    kept = L.detections("apache license 2 0 and the mit license and all rights reserved")
    assert {d[4] for d in kept} == {"apache-2", "mit", "proprietary"}
    for a in kept:
        assert not any(b is not a and b[1] <= a[1] and a[2] <= b[2] and b[0] <= a[0] for b in kept)


def test_every_rule_passes_its_own_filter():
    for (_, _, label, pattern), (near, heads) in zip(*L.rules()):
        assert near and heads
    for label, name in L.NAMES.items():
        first = re.sub(r"\(\?:[^()]*\)\??", "", name.split("|")[0] if "(" not in name.split("|")[0] else re.split(r"\|(?![^(]*\))", name)[0])
        first = re.sub(r" \?", " ", first).replace("\\d", "4").replace("?", "").strip()
        assert L.detections(f"spdx license identifier {first}"), (label, first)


def test_odd_rows(spark, odd, nothing):
    rows = L.scan(odd).collect()
    assert len(rows) == odd.count()
    assert {(r["n_words"], r["first_word"], r["labels"], r["score"]) for r in rows if r["doc_id"] in (2, 3, 4)} == {(0, None, "", 0.0)}
    assert L.scan(nothing).count() == 0
    other = odd.withColumn("k", F.col("doc_id"))
    assert L.scan(other, doc_id="k").columns == L.scan(odd).columns and L.scan(other, doc_id="k").count() == len(rows)


def by_pairs(line):
    """Every detection against all others, by the definition."""
    found = [(p, m.start(), m.end(), c, label, at) for at, (p, c, label, pattern) in enumerate(L.rules()[0]) for m in pattern.finditer(line)]

    def beats(a, b):
        return a[1] <= b[1] and b[2] <= a[2] and (a[0], a[1] - a[2], a[5]) < (b[0], b[1] - b[2], b[5])
    return {d[:5] for d in found if not any(beats(e, d) for e in found)}


@pytest.mark.parametrize("seed", range(20))
def test_suppression_by_definition(seed):
    words = "licensed under the mit apache license version 2 0 cc by nc sa 4 gpl 3 spdx identifier all rights reserved terms of bsd clause public domain x".split()
    line = " ".join(random.Random(seed).choices(words, k=300))
    for text in (line, "released under the terms of the apache license version 2 0 license", "gnu general public license version 3 " * 3):
        got = L.detections(text.strip())
        assert len(got) == len(set(got)) and set(got) == by_pairs(text.strip())


def test_long_texts_of_detections_only():
    """2 MB of one phrase: time grows with the length."""
    n = 220_000
    start = time.process_time()
    got = L.scan_text("CC-BY-NC " * n)
    assert time.process_time() - start < 20
    assert got[:4] == (3 * n, n, 0, 3 * n - 3) and len(got[7]) == n and got[7][-1] == ("cc-by-nc", 3 * n - 3, 3)
