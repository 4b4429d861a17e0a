"""Grid positions, interpolation rules, runs, bins, copies and seeded draws."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.functions import columns as C
from tidewright.functions.gridtime import position, slot_start
from tidewright.functions.holidays import us_holidays
from tidewright.operators import clean, grid


@pytest.mark.parametrize("freq", ["minute", "hour", "day", "week", "month", "year"])
def test_slot_start_inverts_position(spark, freq):
    stamps = ["1969-12-29 00:00:00", "1995-03-26 02:30:00", "2000-02-29 23:59:00", "2024-01-01 00:00:00", "2024-11-03 01:30:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    rows = df.select("ts", slot_start(position(F.col("ts"), freq), freq).alias("cut")).collect()
    pandas_freq = {"minute": "min", "hour": "h", "day": "D", "week": "W-SUN", "month": "M", "year": "Y"}[freq]
    for r in rows:
        assert r["cut"] == pd.Timestamp(r["ts"]).to_period(pandas_freq).start_time.to_pydatetime()


def _gappy(spark):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "s string, p long, v double")


def test_interpolation_keeps_the_lead_missing_and_holds_the_tail(spark):
    out = grid.interpolate(_gappy(spark), ["s"], "p", "v", "x").orderBy("p").toPandas()["x"].tolist()
    assert np.isnan(out[0]) and out[1:] == [1.0, 2.0, 3.0, 4.0, 4.0]
    filled = grid.interpolate(_gappy(spark), ["s"], "p", "v", "x", fill_leading=True).orderBy("p").first()
    assert filled["x"] == 1.0


def test_gap_runs_and_run_length_per_point(spark):
    runs = grid.run_table(_gappy(spark), ["s"], "p", F.col("v").isNull()).orderBy("run_start").collect()
    assert [r["run_length"] for r in runs] == [1, 2, 1]
    points = grid.mark_runs(_gappy(spark), ["s"], "p", F.col("v").isNull()).orderBy("p").collect()
    assert [r["run_length"] for r in points] == [1, None, 2, 2, None, 1]


def test_spine_hygiene_and_missing_slots(spark):
    df = spark.createDataFrame([("s", 3), ("s", 3), ("s", 5), ("t", 1)], "s string, p long")
    h = {r["s"]: r for r in grid.hygiene(df, ["s"], "p").collect()}
    assert (h["s"]["n_duplicates"], h["s"]["n_missing"], h["t"]["n_expected"]) == (1, 1, 1)
    assert [tuple(r) for r in grid.missing_slots(df, ["s"], "p").collect()] == [("s", 4)]
    long = spark.createDataFrame([("s", 0), ("s", 9999)], "s string, p long")
    assert grid.spine(long, ["s"], "p").agg(F.count("*"), F.sum("p")).first()[:] == (10000, 49995000)


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (12.0,), (12.1,), (35.4,), (-5.0,)], "v double")
    out = {r["v"]: r["b"] for r in df.select("v", C.bins(F.col("v"), (-0.1, 12, 35.4), ("low", "mid")).alias("b")).collect()}
    assert out == {0.0: "low", 12.0: "low", 12.1: "mid", 35.4: "mid", -5.0: None}


def test_coercion_and_sentinels(spark):
    df = spark.createDataFrame([("1.5", 3), (" ", 0), ("x", 1)], "raw string, k int").withColumn("n", C.to_number(F.col("raw")))
    assert [r["n"] for r in df.orderBy("k").collect()] == [None, None, 1.5]
    assert {r["k"] for r in clean.coercion_failures(df, "raw", "n", "k").collect()} == {0, 1}


def test_keep_first_and_copies(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, "only")], "k string, o int, v string")
    assert {r["k"]: r["v"] for r in clean.keep_first(df, ["k"], ["o"]).collect()} == {"a": "early", "b": "only"}
    twice = df.unionByName(df.filter("k = 'b'"))
    assert {r["k"]: r["copies"] for r in clean.exact_copies(twice).collect() if r["o"] == 1} == {"a": 1, "b": 2}


def test_sample_and_draws_ignore_partitioning(spark):
    df = spark.range(2000).withColumn("v", F.col("id") * 2)
    pick = [sorted(r["id"] for r in clean.hash_sample(df.repartition(n), C.portable_hash(F.col("id")), 50).collect()) for n in (1, 9)]
    assert pick[0] == pick[1] and len(pick[0]) == 50
    z = df.repartition(11).select(C.hash_normal(F.col("id"), seed=4).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(z[0]) < 0.1 and abs(z[1] - 1) < 0.1


def test_fourier_origin_keeps_phase(spark):
    df = spark.range(48, 52).select(F.col("id").alias("p"))
    out = df.select("p", C.fourier(F.col("p"), 0, [(24, 1)])["sin_24_1"].alias("s")).toPandas()
    assert np.allclose(out["s"], np.sin(2 * np.pi * out["p"] / 24))


def test_holiday_rules():
    days = dict((d.isoformat(), n) for d, n in us_holidays(2017, 2022))
    assert days["2017-11-23"] == "Thanksgiving" and days["2018-05-28"] == "Memorial Day" and "2022-06-20" in days
    assert "2017-06-19" not in days


def test_normal_quantile(spark):
    df = spark.createDataFrame([(p,) for p in (0.001, 0.025, 0.5, 0.9, 0.975, 0.9999)], "p double")
    out = df.select(C.normal_quantile(F.col("p")).alias("z")).toPandas()["z"]
    assert np.allclose(out, [-3.0902323, -1.9599640, 0.0, 1.2815516, 1.9599640, 3.7190165], atol=1e-6)


def test_season_and_weekday(spark):
    df = spark.createDataFrame([(datetime(2024, 12, 30),), (datetime(2024, 7, 7),)], "ts timestamp_ntz")
    assert [tuple(r) for r in df.select(C.season(F.col("ts")), C.is_weekend(F.col("ts"))).collect()] == [("winter", 0), ("summer", 1)]
