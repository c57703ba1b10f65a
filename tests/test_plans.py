import pytest
from pyspark.sql import functions as F

from themeloom.plans.joins import lookup_join, measured_size
from themeloom.plans.lineage import cut
from themeloom.plans.spread import spread


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_ways_agree_on_hot_and_null_keys(spark, how):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 40).alias("k")
    )
    table = spark.range(30).select(F.when(F.col("id") == 29, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    small = lookup_join(rows, table, ["k"], how)
    large = lookup_join(rows, table, ["k"], how, broadcast_bytes=0, hot_keys=10)
    assert large.columns == ["id", "k", "x"]
    assert small.count() == large.count()
    assert small.exceptAll(large).isEmpty()
    if how == "left":
        assert small.count() == 3000


def test_even_keys_above_the_bound_are_not_broadcast(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 40).alias("k"))
    table = cut(spark.range(40).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 100_000).alias("x")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # else Spark broadcasts the few rows
    try:
        joined = lookup_join(rows, table, ["k"], broadcast_bytes=1_000_000)
        assert "BroadcastExchange" not in joined._jdf.queryExecution().toString()
        assert joined.count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sizes_are_measured(spark):
    table = spark.range(5).select("id", F.repeat(F.lit("x"), 1000).alias("x"), F.sequence(F.lit(1), F.lit(100)).alias("a"))
    rows, size, largest = measured_size(table)
    assert rows == 5 and 5 * 1800 < size < 5 * 2000 and largest == size // 5


def test_cut_keeps_rows_and_types(spark):
    df = spark.range(10).select("id", F.array(F.col("id").cast("double")).alias("v"))
    copy = cut(df)
    assert copy.schema.simpleString() == df.schema.simpleString() and copy.count() == 10
    assert "Range" not in copy._jdf.queryExecution().toString()


def test_spread(spark):
    one = spark.range(0, 100, 1, 1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 50)
    assert spread(many) is many


def test_length_filter_and_columns_reach_the_scan(spark):
    from themeloom.catalog import QUERIES

    plan = QUERIES["stratum_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line][0]
    assert "ReadSchema: struct<text:string,lang:string>" in scan
    assert "IsNotNull(text)" in scan
