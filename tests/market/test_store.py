"""The bar store: what a scan reads, and what it needs not move."""

import datetime as dt

import pytest
from pyspark.sql import Window, functions as F

from barloom.sources import bars as src


@pytest.fixture(scope="module")
def store(spark):
    rows = [(f"S{j}", dt.date(2010, 1, 1) + dt.timedelta(days=30 * i), float(i + j)) for j in range(20) for i in range(60)]
    return src.store_bars(spark.createDataFrame(rows, "symbol string, ts date, close double"), "barloom_test_store", buckets=4)


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_years_and_symbols_are_pruned(store):
    got = src.scan_store(store, ["S3"], "2011-03-01", "2012-02-28")
    want = store.drop("year").where("symbol = 'S3' and ts between date'2011-03-01' and date'2012-02-28'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 12
    plan = plan_of(got)
    assert "PartitionFilters: [isnotnull(year" in plan and "EqualTo(symbol,S3)" in plan.split("PushedFilters")[1].split("]")[0]
    assert len(got.inputFiles()) < len(store.inputFiles()) / 2


def test_windows_and_joins_need_no_exchange(store, spark):
    some = src.scan_store(store, None, "2010-06-01", "2013-01-01")
    lagged = some.withColumn("before", F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")))
    assert "Exchange" not in plan_of(lagged)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        other = src.scan_store(store, None, "2010-06-01", "2013-01-01").withColumnRenamed("close", "other")
        assert "Exchange" not in plan_of(some.join(other, ["symbol", "ts"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
