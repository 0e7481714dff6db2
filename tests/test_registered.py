"""Every registered query with SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from labelloom.plans.queries import ORACLES, QUERIES
from labelloom.plans.register import rounded

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(df, cols):
    told = lambda v: (f"{v:.5f}" if v == v else "nan") if isinstance(v, float) else str(v)
    return sorted(map(tuple, df[cols].astype(object).map(told).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0  # what they give is held against rules in test_scale_forms and test_model_rules


def test_roc_points_of_counts_that_end_in_halves(spark, tmp_path):
    # 12,800 normals, a defect after each four: rates such as 0.0628125 lie between two of six places.
    flag = F.when(F.col("id") % 5 == 4, "R").otherwise("N")
    lines = spark.range(16_000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(1).cast("long").alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), (50_000.0 - F.col("id")).alias("l_extendedprice"), F.lit(7.0).alias("l_quantity"), flag.alias("l_returnflag"))
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(1, 2).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand")).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    told = lambda df: set(map(tuple, df[["category", "fpr", "tpr", "threshold"]].values.tolist()))
    got, want = told(QUERIES["G4_roc_points"](spark, str(tmp_path)).toPandas()), told(con.execute(ORACLES["G4_roc_points"]).df())
    assert len(want) > 6_000 and got == want


def test_rounding_keeps_what_has_no_six_places(spark):
    rows = [(float("nan"),), (float("inf"),), (-float("inf"),), (1e305,), (None,), (-0.4375,), (2.5e-7,)]
    got = [r["x"] for r in rounded(spark.createDataFrame(rows, "x double").coalesce(1)).collect()]
    assert got[0] != got[0] and got[1:] == [float("inf"), -float("inf"), 1e305, None, -0.4375, 0.0]
