"""Queries and operators that must use every row, against plain counts and folds."""

import os

import pytest
from pyspark.sql import functions as F

from gristmill.operators import spatial
from gristmill.plans import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_typed_requests_answer_every_order(spark):
    orders = {str(r[0]): r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()}
    got = {r["id"]: r for r in QUERIES["typed_requests"](spark, SF).collect()}
    assert set(got) == set(orders)
    for i, key in orders.items():
        noul = key % 3 == 0
        assert got[i]["kind"] == ("noul" if noul else "choice")
        assert (got[i]["n"], got[i]["p_first"], got[i]["p_last"]) == ((2, 0.333333, 0.666667) if noul else (5, 0.066667, 0.333333))
        assert got[i]["choice"] == (None if noul else "5-LOW") and got[i]["value"] == (0.666667 if noul else None)


def test_greedy_boxes_reach_beyond_many_near_ones(spark):
    # 80 boxes on the target, then 80 on one place, then two clear ones; all of one role.
    rows = [(1, 0, 0.0, 10.0)] + [(1, i, 0.01 * i, 10.0) for i in range(1, 81)] + [(1, i, 20.0 + 0.001 * i, 10.0) for i in range(81, 161)] + [(1, 161, 40.0, 10.0), (1, 162, 60.0, 10.0)]
    df = spark.createDataFrame(rows, "g int, element int, l double, w double").select("*", F.lit("a").alias("role"), F.lit(0.0).alias("t"), F.lit(10.0).alias("h"))
    assert [r["element"] for r in spatial.greedy_distinct(df, "g", F.col("element") == 0, 3).orderBy("place").collect()] == [81, 161, 162]
