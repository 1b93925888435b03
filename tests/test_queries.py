"""Every query against its oracle SQL, on the smallest fixture."""

import glob
import os

import duckdb
import pytest

from ledgerlake.operators import kv, ordering
from ledgerlake.plans import catalogue
from ledgerlake.sources import inputs, storage

NAMES = sorted(catalogue.queries())


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_oracle(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    if name in catalogue.oracle_sql():
        want = duck.sql(catalogue.oracle_sql()[name])
        assert sorted(want.columns) == columns
        order = [want.columns.index(c) for c in columns]
        assert rows == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())
    else:
        assert rows


ORDERED = ["a18_heat", "a19_write_pressure", "a6_percentiles", "a15_failure_detection", "c10_arm_mean", "c15_guards", "d18_members", "j5_as_of", "j6_happens_before", "p10_sustained", "p1_rate", "r12_watch", "w2_transitions", "w3_elections", "w4_confirm_latency", "w7_trend"]


@pytest.mark.parametrize("name", ORDERED)
def test_keys_cut_into_ranges_equal_oracle(spark, sf, duck, name, monkeypatch):
    monkeypatch.setattr(ordering, "LARGE", 0)
    test_equals_oracle(spark, sf, duck, name)


def test_range_filter_reaches_the_scan_of_a_run(spark, sf, tmp_path, capsys):
    storage.write_run(inputs.mutations(spark, sf), f"{tmp_path}/run", files=4)
    kv.scan(storage.read_runs(spark, [f"{tmp_path}/run"]), "17", "3", catalogue.NOW).select("key", "value").explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(key,17)" in pushed and "LessThan(key,3)" in pushed
