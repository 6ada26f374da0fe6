"""Every registered query against its SQL twin, and the shape of its plan."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract
from driftgrid.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def ordered(df):
    columns = sorted(df.columns)
    keys = [c for c in columns if df[c].dtype.kind != "f"] + [c for c in columns if df[c].dtype.kind == "f"]
    return df[columns].sort_values(keys).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = df.toPandas()
    assert len(got) > 0
    if name not in ORACLE:
        assert not got.isna().all().any()
        return
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    got, want = ordered(got), ordered(want)
    for c in got.columns:
        if want[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=0, atol=1.1e-6)
        else:
            assert (got[c].astype(object) == want[c].astype(object)).all(), c


def test_entry(spark):
    row = contract.entry(spark).collect()
    assert len(row) == 1 and row[0]["frames"] > 0


def test_oracle_keys_are_queries():
    assert set(ORACLE) <= set(QUERIES) <= set(contract.queries())
    assert set(ORACLE) <= set(contract.oracle_sql()) <= set(contract.queries())
