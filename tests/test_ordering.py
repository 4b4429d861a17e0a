"""Distributed ordering against pandas, with hot groups, ties and block edges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import ordering as od


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    g = rng.choice(["hot", "a", "b", "c"], 4000, p=[0.7, 0.1, 0.1, 0.1])
    v = np.where(rng.random(4000) < 0.35, 7.0, np.round(rng.normal(5, 3, 4000), 2))
    pdf = pd.DataFrame({"g": g, "v": v, "id": np.arange(4000)})
    return spark.createDataFrame(pdf).repartition(7), pdf


def test_sorted_scan_matches_cumulative_sums(skewed):
    df, pdf = skewed
    out = od.sorted_scan(df, ["g"], [F.col("v"), F.col("id")], {"cum": "v"}, row_number="rn", totals=True).toPandas().sort_values("id")
    want = pdf.sort_values(["g", "v", "id"])
    want["cum"], want["rn"] = want.groupby("g")["v"].cumsum(), want.groupby("g").cumcount() + 1
    want = want.sort_values("id")
    assert np.allclose(out["cum"], want["cum"]) and (out["rn"].to_numpy() == want["rn"].to_numpy()).all()
    assert (out["rn_total"].to_numpy() == want.groupby("g")["v"].transform("size").to_numpy()).all()


@pytest.mark.parametrize("parts", [1, 13])
def test_quantiles_match_pandas_whatever_the_partitioning(skewed, parts):
    df, pdf = skewed
    probs = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    out = od.quantiles(df.repartition(parts), ["g"], "v", probs).toPandas().set_index("g")
    for name, p in probs.items():
        assert np.allclose(out[name], pdf.groupby("g")["v"].quantile(p).reindex(out.index))


def test_finite_sample_level_is_an_order_statistic(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "e double")
    out = od.quantiles(df, [], "e", {}, finite_sample={"q": 0.8, "top": 0.99}).first()
    assert out["q"] == 9.0 and out["top"] == 10.0  # ceil(11 * 0.8) = 9, and the cap at n


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    assert {r["v"]: r["rank"] for r in od.average_ranks(df, [], "v").collect()} == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(2)
    rows = [(s, i, None if rng.random() < 0.2 else float(np.round(rng.normal(), 3))) for s in ("x", "y") for i in range(60)]
    pdf = pd.DataFrame(rows, columns=["s", "p", "v"])
    return spark.createDataFrame(rows, "s string, p long, v double").repartition(5), pdf


@pytest.mark.parametrize("block", [8, 17, 4096])
def test_look_around_does_not_see_block_edges(panel, block):
    df, pdf = panel
    out = od.look_around(df, ["s"], "p", {"l": od.lag_of("v", 3), "f": od.lag_of("v", -2), "m": od.rolling("mean", "v", 5, 1),
                                          "c": od.centred("sum", "v", 2, 1)}, block=block).toPandas().sort_values(["s", "p"])
    assert len(out) == len(pdf)
    g = pdf.sort_values(["s", "p"]).groupby("s")["v"]
    assert np.allclose(out["l"], g.shift(3), equal_nan=True) and np.allclose(out["f"], g.shift(-2), equal_nan=True)
    assert np.allclose(out["m"], g.transform(lambda x: x.shift(1).rolling(5).mean()), equal_nan=True)
    assert np.allclose(out["c"], g.transform(lambda x: x.shift(-1).rolling(4).sum()), equal_nan=True)


@pytest.mark.parametrize("block", [8, 4096])
def test_running_totals_and_fills(panel, block):
    df, pdf = panel
    out = od.running(df, ["s"], "p", sums={"cum": F.coalesce("v", F.lit(0.0))}, last={"a": "v"}, following={"b": "v"}, block=block)
    out = out.select("s", "p", "cum", F.col("a.value").alias("a"), F.col("b.value").alias("b")).toPandas().sort_values(["s", "p"])
    g = pdf.sort_values(["s", "p"]).groupby("s")["v"]
    assert np.allclose(out["cum"], g.transform(lambda x: x.fillna(0).cumsum()))
    assert np.allclose(out["a"], g.ffill(), equal_nan=True) and np.allclose(out["b"], g.bfill(), equal_nan=True)


def test_absent_slot_is_a_missing_lag(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 2.0), ("s", 3, 4.0)], "s string, p long, v double")
    out = {r["p"]: r["l"] for r in od.look_around(df, ["s"], "p", {"l": od.lag_of("v", 1)}).collect()}
    assert out == {0: None, 1: 1.0, 3: None}
