import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import ordinal as O


def test_held_out_accuracy(spark, small):
    folder = f"{small}/../sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    grades = O.quality_grades(spark.read.parquet(f"{folder}/labels.parquet")).withColumn("test", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(4)) == 0)
    model = O.fit(docs, grades.where("not test"))
    assert np.all(np.diff(model.thresholds) > 0)
    rows = O.score(docs, model, ["doc_id"]).join(grades.where("test"), "doc_id").collect()
    kept = {g: np.mean([r["accepted"] for r in rows if r["grade"] == g]) for g in (0, 1, 2)}
    assert kept[2] > 0.99 and kept[1] < 0.05 and kept[0] < 0.15
    means = [np.mean([r["expected_grade"] for r in rows if r["grade"] == g]) for g in (0, 1, 2)]
    assert means[0] < means[1] < means[2]


def test_fit_recovers_an_order():
    rng = np.random.default_rng(4)
    x = rng.random((600, 3))
    z = 6 * x[:, 0] - 6 * x[:, 1] + rng.logistic(size=600)
    y = np.digitize(z, [-1.5, 1.5])
    m = O.fit_rows([(np.arange(3), r.astype(np.float32)) for r in x], y, 3, rounds=300)
    assert m.weights[0] > 3 and m.weights[1] < -3 and abs(m.weights[2]) < 2
    p = np.array([m.probabilities((np.arange(3), r)) for r in x])
    assert np.allclose(p.sum(1), 1) and np.mean(p.argmax(1) == y) > 0.6


def test_sample_is_bounded_and_odd_rows_have_results(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (8, None, 1), (None, 1, 0), (2, 1, 0), (3, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    grades = O.quality_grades(labels)
    assert sorted(r["grade"] for r in grades.where("grade is not null").collect()) == [0, 1, 1, 2, 2, 2]
    model = O.fit(odd, grades)
    rows = O.score(odd, model, ["doc_id", "text", "size"]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r["expected_grade"] <= 2
        if not (r["text"] or "").strip():
            assert not r["accepted"] and r["expected_grade"] == 0
    assert odd.where(O.accepted(spark, model)).count() == sum(r["accepted"] for r in rows)
    copies = O.fit(odd.unionByName(odd).unionByName(odd), grades)  # a document counts once, however many rows it has
    assert np.array_equal(copies.weights, model.weights) and np.array_equal(copies.thresholds, model.thresholds)
    none = O.fit(odd, labels.where("doc_id = 99").withColumn("grade", F.lit(1)))
    assert none is None and all(r["accepted"] == bool((r["text"] or "").strip()) for r in O.score(odd, none, ["text"]).collect())
    assert O.score(nothing, model, ["doc_id"]).count() == 0


def test_fit_against_rows_one_by_one():
    """Every step of the fit, by a loop over rows: likelihood by the definition, slopes by finite differences."""
    rng = np.random.default_rng(7)
    cells = [np.sort(rng.choice(6, 3, replace=False)) for _ in range(30)]
    vectors = [(c, rng.random(3).astype(np.float32)) for c in cells]
    y = rng.integers(0, 3, 30)
    rounds, penalty = 4, 2e-5

    def loss(w, q):
        cuts = [q[0], q[0] + np.exp(q[1])]
        total = 0.0
        for (at, val), g in zip(vectors + [(np.empty(0, int), np.empty(0))] * 3, [*y, 0, 1, 2]):
            z = sum(w[a] * float(v) for a, v in zip(at, val))
            upto = [0.0, *(1 / (1 + np.exp(z - c)) for c in cuts), 1.0]
            total -= np.log(upto[g + 1] - upto[g])
        return total / 33 + penalty / 2 * float(w @ w)

    share = np.cumsum(np.bincount([*y, 0, 1, 2]))[:-1] / 33
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(6), start[:1], np.log(np.diff(start))])
    mean, square = np.zeros(8), np.zeros(8)
    for t in range(1, rounds + 1):
        g = np.array([(loss((p + e)[:6], (p + e)[6:]) - loss((p - e)[:6], (p - e)[6:])) / 2e-6 for e in np.eye(8) * 1e-6])
        g[np.abs(g) < 1e-8] = 0  # the thresholds start where their slopes are nought; differences leave rounding there, which the step would blow up
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        p = p - 0.5 * (1 - t / (rounds + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    m = O.fit_rows(vectors, y, 3, rounds=rounds, penalty=penalty)
    assert np.allclose(m.weights[:6], p[:6], atol=1e-3) and np.allclose(m.thresholds, [p[6], p[6] + np.exp(p[7])], atol=1e-3)
    assert not m.weights[6:].any()
    for x in vectors:
        z = sum(m.weights[a] * float(v) for a, v in zip(*x))
        upto = [0.0, *(1 / (1 + np.exp(z - c)) for c in m.thresholds), 1.0]
        assert np.allclose(m.probabilities(x), [upto[1] - upto[0], upto[2] - upto[1], upto[3] - upto[2]])
