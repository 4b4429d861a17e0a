"""The spectrum of whole series against numpy's transform."""

import numpy as np
import pytest

from tidewright.operators import spectrum as P

SCHEMA = "s string, p long, v double, power string"


def table(spark, known):
    rows = [(k, 50 + i, float(v), "extra") for k, y in known.items() for i, v in enumerate(y) if not np.isnan(v)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("width", [2, 8, 64])
def test_same_as_one_transform(spark, monkeypatch, width):
    monkeypatch.setattr(P, "WIDTH", width)
    rng = np.random.default_rng(3)
    known = {f"n{n}": rng.normal(size=n) * 10 + 100 for n in (2, 3, 7, 64, 97, 360)} | {None: rng.normal(size=211)}
    got = {}
    for r in P.whole_spectrum(table(spark, known), ["s"], "p", "v").collect():
        got.setdefault(r["s"], {})[r["k"]] = r
    assert set(got) == set(known)
    for name, y in known.items():
        n, x = len(y), np.fft.rfft(y - y.mean())
        assert sorted(got[name]) == list(range(1, n // 2 + 1))
        for k, r in got[name].items():
            assert np.isclose(r["re"] + 1j * r["im"], x[k], atol=1e-8)
            assert np.isclose(r["power"], abs(x[k]) ** 2 / n * (1 if 2 * k == n else 2), atol=1e-8)
            assert r["period"] == n / k
        assert np.isclose(sum(r["power"] for r in got[name].values()), ((y - y.mean()) ** 2).sum())


def test_a_long_series_with_gaps(spark, monkeypatch):
    monkeypatch.setattr(P, "WIDTH", 4)
    i = np.arange(5001)
    y = 4 * np.sin(2 * np.pi * i / 24) + 2 * np.cos(2 * np.pi * i / 168) + np.random.default_rng(4).normal(size=len(i))
    y[100:2000][np.arange(1900) % 128 < 64] = np.nan  # whole blocks of columns have few slots or none
    x = np.fft.rfft(np.where(np.isnan(y), 0, y - np.nanmean(y)))
    spectrum = P.whole_spectrum(table(spark, {"x": y}), ["s"], "p", "v")
    assert np.allclose([r["re"] + 1j * r["im"] for r in spectrum.orderBy("k").collect()], x[1:], atol=1e-6)
    top = P.dominant_periods(spectrum, ["s"], 3).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and abs(top[0]["period"] - 24) < 0.1
    assert np.isclose(top[0]["share"], top[0]["power"] / (np.abs(x[1:]) ** 2 * 2 / len(y)).sum())


def test_odd_and_empty_tables(spark):
    assert P.whole_spectrum(spark.createDataFrame([], SCHEMA), ["s"], "p", "v").count() == 0
    df = spark.createDataFrame([("one", 3, 1.0, ""), ("none", 1, None, ""), ("none", 4, float("nan"), "")], SCHEMA)
    rows = P.whole_spectrum(df, ["s"], "p", "v").collect()
    assert [(r["s"], r["power"]) for r in rows] == [("none", 0.0)] * 2
    single = spark.createDataFrame([(i, float(i % 2)) for i in range(8)], "p long, v double")
    assert P.dominant_periods(P.whole_spectrum(single, [], "p", "v"), [], 1).first()["k"] == 4
