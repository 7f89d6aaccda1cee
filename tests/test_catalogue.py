"""Each registered query against its SQL in DuckDB, on the smallest tables, or on those of TEST_SF_DIRS."""

import os

import duckdb
import pytest
from pyspark.sql import SparkSession

from skein.plans.registry import REGISTRY

SIZES = os.environ.get("TEST_SF_DIRS", "/root/testdata/sf0.001").split(",")


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


@pytest.mark.parametrize("data", SIZES)
@pytest.mark.parametrize("name", [n for n in REGISTRY if REGISTRY[n][1]])
def test_query_equals_sql(spark, name, data):
    query, sql = REGISTRY[name]
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    got, want = query(spark, data), con.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda rows: sorted(rows, key=repr)
    mine = order([tuple(r) for r in got.select(*columns).collect()])
    theirs = order(con.sql(sql).select(*columns).fetchall())
    assert mine == theirs  # to the last bit: both sides round
