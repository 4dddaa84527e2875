"""Joins and components where one key holds most rows."""

from pyspark.sql import functions as F

from gristmill.operators.graph import connected_components
from gristmill.operators.skew import spread_join


def test_spread_join_is_the_inner_join_and_spreads_hot_keys(spark):
    rows = spark.range(0, 6000, 1, 12).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 500 == 1, F.lit(None)).otherwise(F.col("id") % 1000).alias("k"), F.col("id").alias("v"))
    side = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    want = sorted(tuple(r) for r in rows.join(side.drop("n"), "k").select("k", "v", "top").collect())
    got = spread_join(rows, side, "k", "n", 6000)
    assert got.columns == ["k", "v", "top"] and sorted(tuple(r) for r in got.collect()) == want
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    most = spread_join(rows, side, "k", "n", 6000).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert most < 2000  # the 2,000 rows of key 7 did not meet


def test_components_of_a_hub_and_a_chain(spark):
    star = [(5000, i) for i in range(1, 1500)]
    chain = [(10_000 + i, 10_001 + i) for i in range(300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(star + chain + [(7, 7), (9000, 9000), (3, None)], "a long, b long")).collect()}
    assert {got[i] for i in range(1, 1500)} == {1} and got[5000] == 1 and {got[10_000 + i] for i in range(301)} == {10_000} and got[9000] == 9000
