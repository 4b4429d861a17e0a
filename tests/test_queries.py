"""Every registered query is known to the driver contract; a spread of them is compared with SQL at the smallest scale."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
spec = importlib.util.spec_from_file_location("check", ROOT / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)
entry = check.entry


def test_contract_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


def test_flagship_query(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and {"series", "model", "mase"} <= set(rows[0].asDict())


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["p15_fixed_bins", "p20_exact_copies", "p21_keep_first", "j1_complete_grid", "w9_interpolated", "w11_run_length_per_point",
                                  "a7_exact_quantiles", "a16_ecdf", "t5_spearman", "t9_cramers_v", "d3_ljung_box", "l17_walk_forward", "l38_quadratic_kappa"])
def test_query_equals_sql(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert check.rows_of([tuple(r) for r in df.collect()], df.columns) == check.rows_of(rel.fetchall(), cols)


def test_cointegration_scans_all_pairs(spark, small):
    assert entry.queries()["m7_cointegration_scan"](spark, small).select("pair").distinct().count() == 10
