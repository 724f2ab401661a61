"""Physical plans: no global windows, no cross products, reused shuffles; and the registered queries."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from helpers import make_log, random_rows

import __spark_entry__ as driver
from tidemark.operators import policies as P
from tidemark.operators.replay import Replay
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import REGISTRY
from tidemark.sources.changelog import changelog, profile

SMALL = "/root/testdata/sf0.001"


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_timeline_plan(spark):
    log = make_log(spark, random_rows(1))
    plan = final_plan(Replay(log, [P.Immediate()]).timeline())
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "ReusedExchange" in plan


def test_unused_columns_are_not_read(spark):
    log = changelog(spark, SMALL)
    plan = Replay(log, [P.FullRefresh(6)]).rows_loaded()._jdf.queryExecution().executedPlan().toString()
    assert "min(ts" not in plan  # the event time is not derived when nothing asks for it


def test_hot_keys_cost_one_more_scan(spark):
    log = make_log(spark, random_rows(1))
    plans = [
        Replay(log, [P.Immediate()], profile=profile(log), hot_rows=limit).versions._jdf.queryExecution().executedPlan().toString()
        for limit in (4, 10**6)
    ]
    scans = [plan.split("== Initial Plan ==")[0].count("Scan ExistingRDD") for plan in plans]
    assert scans == [1, 1]  # and one more that wrote the rows of hot keys
    assert all("CartesianProduct" not in plan for plan in plans)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    rows = [
        tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r)
        for r in frame.itertuples(index=False)
    ]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, tables, name):
    expected = tables.execute(driver.oracle_sql()[name]).df()
    got = driver.queries()[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)
