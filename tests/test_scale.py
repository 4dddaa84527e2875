"""Operators that must not gather a stratum, a group or all clusters: against loops, and their plans."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions.hashing import digest
from gristmill.operators import metrics, sampling, skew


def sha(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_quotas_by_cut(spark, digits):
    rng = random.Random(digits)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, s string, t int").repartition(3)
    quotas = {("hot", 0): 700, ("hot", 1): 0, ("a", 0): 10**9, ("a", 1): 1, ("b", 1): 33}
    table = spark.createDataFrame([(s, t, q) for (s, t), q in quotas.items()], "s string, t int, quota long")
    got = sorted(r["id"] for r in sampling.by_cut(df, ["s", "t"], [digest("id")], table, digits).collect())
    strata = {}
    for i, s, t in rows:
        strata.setdefault((s, t), []).append(i)
    want = sorted(i for k, ids in strata.items() for i in sorted(ids, key=sha)[: quotas.get(k, 0)])
    assert got == want
    fixed = sampling.by_cut(df, ["s"], [digest("id")], 150, digits)
    assert sorted(fixed.columns) == ["id", "s", "t"]
    by_s = {}
    for i, s, _ in rows:
        by_s.setdefault(s, []).append(i)
    assert sorted(r["id"] for r in fixed.collect()) == sorted(i for ids in by_s.values() for i in sorted(ids, key=sha)[:150])
    assert sampling.by_cut(df.where("false"), ["s"], [digest("id")], 5, digits).count() == 0


def test_cut_plan_ranks_one_bin_only(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("s"))
    plan = sampling.by_cut(df, ["s"], [digest("id")], 1200)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if " Window [" in line or "Window [row_number" in line]
    assert windows and all("_bin" in line for line in windows)
    assert sampling.stratum_quota(df, ["s"], [digest("id")], 1200).count() == 3600


def test_class_caps_and_rest(spark):
    rows = [(i, "hot" if i % 10 else f"c{i % 7}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, c string")
    got = sorted(r["id"] for r in sampling.class_cap_union(df, "c", 20, 60, [digest("id")]).collect())
    by_class = {}
    for i, c in rows:
        by_class.setdefault(c, []).append(i)
    first = {i for ids in by_class.values() for i in sorted(ids, key=sha)[:20]}
    assert got == sorted([*first, *sorted({i for i, _ in rows} - first, key=sha)[:60]])


@pytest.mark.parametrize("held", [10**5, 50, 500])
def test_exact_quantiles(spark, held):
    """Small groups by one aggregate, large ones by brackets, with ties, nulls and a hot group."""
    rng = random.Random(held)
    rows = [("hot", round(rng.gauss(0, 5), 2)) for _ in range(6000)] + [("ties", float(rng.randrange(3))) for _ in range(900)]
    rows += [("few", 1.5), ("few", None), ("few", 2.0), (None, 4.0), ("none", None)] + [("even", float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = {"low": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "top": 1.0}
    got = {r["g"]: r for r in metrics.quantiles(df, ["g"], "v", shares, held).collect()}
    for g in {g for g, _ in rows}:
        values = [v for k, v in rows if k == g and v is not None]
        assert got[g]["n"] == len(values)
        for name, p in shares.items():
            assert got[g][name] == (pytest.approx(np.quantile(values, p), abs=1e-6) if values else None)


def test_bootstrap_draws_are_those_stated(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["x", "y", None, *"abcdef"]), rng.randrange(2), rng.randrange(2)) for i in range(200)]
    wide = spark.createDataFrame(rows, "id long, c string, a int, b int").repartition(3)
    got = {r["i"]: r["mean"] for r in metrics.cluster_bootstrap(wide, "c", 20).collect()}
    clusters = {}
    for _, c, a, b in rows:
        n, d = clusters.get(c, (0, 0))
        clusters[c] = (n + 1, d + b - a)
    for i in range(20):
        top = bottom = 0
        for c, (n, d) in clusters.items():
            word = sha(f"boot:{i // 8}" + ("" if c is None else f":{c}"))[8 * (i % 8) :][:8]
            k = sum(int(word, 16) / 2**32 >= p for p in metrics.POISSON)
            top, bottom = top + k * d, bottom + k * n
        assert got[i] == pytest.approx(top / bottom)
    assert metrics.cluster_bootstrap(wide.where("false"), "c", 20).count() == 0


def test_a_key_of_one_six_hundredth_is_spread(spark):
    """With many partitions a key far below 1/512 of the rows is many partitions' mean, so it is hot."""
    assert skew.hot_limit(600_000, 1000) < 1000 < skew.hot_limit(600_000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        rows = spark.range(600_000).select(F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("k"))
        side = rows.groupBy("k").agg(F.count("*").alias("c")).withColumn("v", F.col("k") + 1)
        joined = skew.spread_join(rows, side, "k", "c", 600_000)
        assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.agg(F.count("*"), F.sum("v")).first() == (600_000, sum(range(1001, 600_001)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
