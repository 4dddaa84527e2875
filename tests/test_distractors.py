"""Wrong options against a loop over all texts, with hot groups."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import distractors


def sha(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def by_hand(rows, k, size=64):
    """``row: texts`` from ``(row, group, text)``: the own bucket by digest, then the group's pool by digest."""
    groups = {}
    for _, g, t in rows:
        groups.setdefault(t, set()).add(g)
    n = max(1, -(-len(groups) // distractors.BUCKET))
    bucket = lambda x: int(sha("pool", x)[:8], 16) % n
    place = {t: bucket(t) for t in groups}
    order = sorted(groups, key=lambda t: (sha("pool", t), t))
    pools = {g: [t for t in order if groups[t] != {g}][: max(size, 3 * k)] for g in {g for _, g, _ in rows}}
    out = {}
    for r, g, own in rows:
        b = bucket(r)
        near = sorted((t for t in groups if place[t] == b and t != own and groups[t] != {g}), key=lambda t: sha(r, t))
        far = sorted((t for t in pools[g] if place[t] != b and t != own), key=lambda t: sha(r, t))
        out[r] = (near[:k] + far)[:k]
    return out


@pytest.mark.parametrize("others,groups", [(3, ["x"]), (40, ["x", "y", None]), (2500, ["x", "y", "z"]), (0, ["x"])])
def test_hot_group(spark, others, groups):
    """A group with up to all of 4,000 texts: no rounds, and what a loop over all texts finds."""
    rng = random.Random(others)
    rows = [(i, rng.choice(groups) if i < others else "hot", f"text {i % 3900}") for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string, t string").repartition(3)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"distractors {others}", "")
    got = {}
    for r in distractors.from_other_groups(df, "id", "g", "t", 3).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["t"]))
    assert len(jobs.getJobIdsForGroup(f"distractors {others}")) < 40  # a fixed number, with the stages that AQE runs apart
    spark.sparkContext.setJobGroup("rest", "")
    want = by_hand(rows, 3)
    assert {r: [t for _, t in sorted(v)] for r, v in got.items()} == {r: v for r, v in want.items() if v}
    assert all([i for i, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_odd_rows(spark):
    rows = [(1, "a", None), (2, "b", "t"), (3, None, "u"), (4, "a", "t")]
    got = {(r["id"], r["t"]) for r in distractors.from_other_groups(spark.createDataFrame(rows, "id long, g string, t string"), "id", "g", "t", 5).collect()}
    assert got == {(1, "t"), (1, "u"), (2, "u"), (3, "t"), (4, "u")}
    assert distractors.from_other_groups(spark.createDataFrame([], "id long, g string, t string"), "id", "g", "t", 5).count() == 0


def test_numbers_and_wide_k(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).alias("g"), F.concat(F.lit("t"), F.col("id")).alias("t"))
    got = distractors.from_other_groups(df, "id", "g", "t", 70).groupBy("id").count().collect()
    assert len(got) == 300 and {r["count"] for r in got} == {70}


def vocabulary_by_hand(labels, k, pool=64):
    """``label: [(other, shared)]``; the last resort, labels without a common word, is not checked beyond its number."""
    labels = sorted(set(labels))
    words = {l: set(l.split(" ")) for l in labels}
    first = {}
    for l in sorted(labels, key=lambda l: (sha("pool", l), l)):
        for w in words[l]:
            first.setdefault(w, []).append(l)
    out = {}
    for l in labels:
        share = {o: len(words[l] & words[o]) for o in labels if o != l}
        many = sorted((o for o in share if share[o] > 1), key=lambda o: (-share[o], sha(l, o)))
        one = sorted({o for w in words[l] for o in first[w][:pool] if o != l and share[o] == 1}, key=lambda o: sha(l, o))
        out[l] = [(o, share[o]) for o in (many + one)[:k]]
    return out


@pytest.mark.parametrize("common,vocabulary", [(True, 3000), (True, 40), (False, 60)])
def test_labels_by_shared_words(spark, common, vocabulary):
    """Also where one word is in every label, which must not bring all pairs together."""
    rng = random.Random(vocabulary)
    labels = ["all " * common + " ".join(f"w{x}" for x in rng.sample(range(vocabulary), rng.randrange(1, 4))) for _ in range(700)] + ["", "alone"]
    df = spark.createDataFrame([(l,) for l in labels] + [(None,)], "label string").repartition(3)
    got = {}
    for r in distractors.from_vocabulary(df, "label", 4).collect():
        got.setdefault(r["label"], []).append((r["rank"], r["other"], r["shared"]))
    want = vocabulary_by_hand(labels, 4)
    for l, others in want.items():
        found = sorted(got[l])
        assert [i for i, _, _ in found] == [1, 2, 3, 4]
        assert [(o, n) for _, o, n in found if n] == others


def test_a_word_of_all_labels_brings_no_pairs_together(spark):
    df = spark.range(20_000).select(F.concat(F.lit("all u"), F.col("id"), F.lit(" v"), F.col("id") % 5000).alias("label"))
    spark.sparkContext.setJobGroup("vocabulary", "")
    rows = distractors.from_vocabulary(df, "label", 3)
    assert rows.count() == 60_000 and rows.where("shared < 2").count() == 0  # 4e8 pairs share a word, 60,000 two
