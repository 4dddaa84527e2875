"""Leakage guards with one key that has most rows, and with null keys, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import leakage

RANK = {"train": 0, "dev": 1, "calibration": 2, "test": 3}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(i, rng.choice(["train"] * 8 + ["dev", "calibration", "test"]), "hot" if rng.random() < 0.6 else rng.choice([None, *[f"k{j}" for j in range(200)]]), None if rng.random() < 0.5 else f"m{rng.randrange(300)}") for i in range(1500)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, split string, a string, b string").repartition(4)


KEYS = ("a", "b")


def keys_of(r):
    return [(k, v) for k, v in zip(KEYS, r[2:]) if v is not None]


def test_owners(df, rows):
    owner = {}
    for r in rows:
        for k in keys_of(r):
            owner[k] = max(owner.get(k, 0), RANK[r[1]])
    want = {r[0] for r in rows if all(owner[k] <= RANK[r[1]] for k in keys_of(r))}
    assert {r["id"] for r in leakage.owner_split(df, "id", {k: F.col(k) for k in KEYS}).collect()} == want


def test_shared_with_held_out(df, rows):
    held = {k for r in rows if r[1] != "train" for k in keys_of(r)}
    want = {r[0] for r in rows if r[1] != "train" or not any(k in held for k in keys_of(r))}
    assert {r["id"] for r in leakage.multi_key_anti(df, "id", {k: F.col(k) for k in KEYS}).collect()} == want


def test_groups_in_several_splits(df, rows):
    splits = {}
    for r in rows:
        splits.setdefault(r[2], set()).add(r[1])
    kept, out = leakage.quarantine_groups(df, "a", "split")
    assert {r["id"] for r in kept.collect()} == {r[0] for r in rows if len(splits[r[2]]) == 1}
    assert {r["id"] for r in out.collect()} == {r[0] for r in rows if len(splits[r[2]]) > 1}


def test_first_rows_and_their_report(df, rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (-RANK[r[1]], r[0])):
        groups.setdefault(r[2], []).append(r[0])
    ranked = df.withColumn("p", F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[F.col("split")])
    got = {r["id"]: (r["rn"], r["kept"]) for r in leakage.keep_first(ranked, ["a"], [F.desc("p"), "id"], "id").collect()}
    assert got == {i: (at + 1, ids[0]) for ids in groups.values() for at, i in enumerate(ids)}
    assert {r["id"] for r in leakage.keep_first(ranked, ["a"], [F.desc("p"), "id"]).collect()} == {ids[0] for ids in groups.values()}


def test_collapse(df, rows):
    labels, first = {}, {}
    for r in rows:
        labels.setdefault(r[2], set()).add(r[3]) if r[3] is not None else labels.setdefault(r[2], set())
        first[r[2]] = min(first.get(r[2], r[0]), r[0])
    assert {r["id"] for r in leakage.collapse(df, "a", "b", ["id"]).collect()} == {i for k, i in first.items() if len(labels[k]) <= 1}
