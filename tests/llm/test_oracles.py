"""Queries against their oracle SQL."""

import glob
import os

import duckdb
import pytest

from ledgerlake.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_equals_oracle(spark, name, size):
    con, folder = duckdb.connect(), f"/root/testdata/{size}"
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalogue.queries()[name](spark, folder)
    columns = sorted(df.columns)
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())
