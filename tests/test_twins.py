"""A spread of registered queries against their SQL twins; check.py runs all of them."""

import duckdb
import pytest

from chainspark.compare import compare, duck_rows, register_views, spark_rows

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
NAMES = ("t03_build_transitions", "e08_lambda_star_boundary", "c07_derived_scalars", "j04_coach_faced",
         "i07_basic_interval", "d05_ratio_to_contemporaries", "q09_pressure_did", "x02_visible_goal",
         "l13_network_shift", "r02_coach_runs", "s02_scan_csv", "w12_even_spacing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    register_views(con, SF)
    return con


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, name):
    got = spark_rows(entry_module.queries()[name](spark, SF))
    assert len(got) > 0
    assert compare(got, duck_rows(duck.sql(entry_module.oracle_sql()[name]))) is None


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["team", "e_t", "p_goal", "p_shot"] and df.count() == 6
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
