"""Faults found in round 3."""

import math

from pyspark.sql import functions as F

from tidewright.plans.catalog import QUERIES


def test_logarithms_of_zero_and_less_are_those_of_the_sql(spark, tmp_path):
    rows = [(1, 0.0), (2, -0.0), (3, -1.0), (4, -3.0), (5, None), (6, 1.0)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r for r in QUERIES["p14_value_transforms"](spark, str(tmp_path)).collect()}
    assert got[1]["log_v"] == got[2]["log_v"] == -math.inf and got[6]["log_v"] == 0.0 and got[5]["log_v"] is None
    assert math.isnan(got[3]["log_v"]) and got[3]["log1p_v"] == -math.inf and got[3]["back_v"] == -1.0
    assert all(math.isnan(got[4][c]) for c in ("log_v", "log1p_v", "sqrt_v", "back_v")) and got[5]["log1p_v"] is None


def test_sampled_attributions_are_summed_before_they_are_shuffled(spark, capsys):
    from tidewright.operators.explain import sampled_shapley
    df = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(20)], "id long, a double, b double")
    sampled_shapley(df, "id", ["a", "b"], lambda d: d.withColumn("yhat", F.col("a") * F.col("b")), 4).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan


def test_smote_searches_all_classes_at_once_and_only_for_rows_drawn_from(spark, monkeypatch):
    from tidewright.operators import learn
    asked = []
    real = learn.nearest
    monkeypatch.setattr(learn, "nearest", lambda q, d, *a, **k: asked.append((q.count(), d.count())) or real(q, d, *a, **k))
    rows = [(1000 * g + i, g, float(i), float(g)) for g, n in ((1, 40), (2, 37), (3, 38)) for i in range(n)]
    out = learn.smote_balanced(spark.createDataFrame(rows, "id long, grade int, a double, b double"), "grade", "id", ["a", "b"])
    made = out.filter("new_id IS NOT NULL").collect()
    assert asked == [(5, 75)]  # before: two searches, all 75 rows asking
    assert sorted((r["grade"], r["new_id"]) for r in made) == [(2, 0), (2, 1), (2, 2), (3, 0), (3, 1)]
    assert all(r["b"] == r["grade"] and 0 <= r["a"] <= 37 for r in made)


def test_calibration_is_fitted_on_distinct_scores(spark, monkeypatch):
    from tidewright.operators import learn
    seen = []
    for name in ("LogisticRegression", "IsotonicRegression"):
        real = getattr(learn, name)
        monkeypatch.setattr(learn, name, type(name, (real,), {"fit": lambda self, df, real=real: seen.append(df.count()) or real.fit(self, df)}))
    rows = spark.createDataFrame([(i, i % 2, (i // 2 % 5) / 5 + 0.1, int(i % 7 < i // 2 % 5)) for i in range(400)], "id long, fold int, raw double, y int").cache()
    for method in ("platt", "isotonic"):
        out = learn.calibrate(rows, "y", "fold", 2, method).groupBy("raw").agg(F.avg("calibrated").alias("c"), F.avg("y").alias("m")).orderBy("raw").collect()
        assert len(out) == 5 and all(abs(r["c"] - r["m"]) < 0.15 for r in out) and [r["c"] for r in out] == sorted(r["c"] for r in out)
    assert len(seen) == 4 and max(seen) <= 10  # before: 200 rows each


def test_kmeans_starts_share_passes_and_leave_out_missing_features(spark, monkeypatch):
    import numpy as np

    from tidewright.operators import multivariate as mv
    rng = np.random.default_rng(2)
    middles = np.array([[0.0, 0.0], [100.0, 3.0], [3.0, 100.0], [-90.0, 80.0]])
    x = np.concatenate([m + rng.normal(size=(60, 2)) for m in middles])
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)] + [(900, None), (901, [None, 1.0]), (902, [math.nan, 1.0])]
    df = spark.createDataFrame(rows, "id long, f array<double>").repartition(5, "id")
    passes, real = [], mv._sums
    monkeypatch.setattr(mv, "_sums", lambda r, sets: passes.append(len(sets)) or real(r, sets))
    model = mv.kmeans(df, "f", 4)
    assert len(passes) <= 3 + 30 and passes[:4] == [10] * 4  # before: as many passes for each of ten starts
    want = np.array([x[60 * j:60 * j + 60].mean(axis=0) for j in range(4)])
    want = want[np.lexsort(want.T[::-1])]
    assert np.allclose(model.centres, want)
    far = ((x[:, None] - want[None]) ** 2).sum(axis=2)
    assert np.isclose(model.cost, far.min(axis=1).sum())
    got = {r["id"]: r["cluster"] for r in mv.assign(df, model, "f").collect()}
    assert [got[i] for i in range(len(x))] == far.argmin(axis=1).tolist()
    assert [got[i] for i in (900, 901, 902)] == [None] * 3  # before: an error
    again = mv.kmeans(df.coalesce(1), "f", 4)
    assert np.allclose(again.centres, model.centres)
    assert len(mv.kmeans(df.filter("id < 2"), "f", 4).centres) == 2 and {r["cluster"] for r in mv.assign(df, mv.kmeans(df.filter("id < 0"), "f", 4), "f").collect()} == {None}


def test_boosting_moves_bins_and_not_a_row_per_class_and_feature(spark, monkeypatch):
    from tidewright.operators import boosting as bt
    moved, real = [], bt._histograms

    def counted(*args):
        cells = real(*args)
        moved.append(args[0].count())
        return cells

    monkeypatch.setattr(bt, "_histograms", counted)
    rows = spark.createDataFrame([(float(i % 50), float(i % 7), i % 3) for i in range(3000)], "a double, b double, g int").coalesce(1)
    forest = bt.fit(rows, ["a", "b"], "g", "softmax", [0, 1, 2], rounds=5, depth=2, store_every=2)
    assert len(forest.trees) == 5 and len(moved) == 10 and max(moved) <= 2  # blocks; before: 18,000 rows a level


def test_one_vs_rest_scores_without_a_python_function_per_class(spark, capsys):
    from tidewright.operators import forecast, learn
    rows = spark.createDataFrame([(float(i % 11), float(i % 7), float((i * i) % 4)) for i in range(400)], "a double, b double, code double").cache()
    model = learn.classifier("boosted_multi", "code", rounds=2, depth=2).fit(forecast.assemble(rows, ["a", "b"]))
    out = learn.score(model, rows, ["a", "b"], "p")
    out.explain()
    assert "EvalPython" not in capsys.readouterr().out  # before: one for each class
    want = {(r["a"], r["b"]): r["prediction"] for r in model.transform(forecast.assemble(rows, ["a", "b"])).collect()}
    got = out.collect()
    assert out.columns == ["a", "b", "code", "p"] and len(got) == 400 and all(r["p"] == want[r["a"], r["b"]] for r in got)
