"""Golden cases, invariants and brute force for what SQL does not cover."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import hashing, vectors
from gristmill.operators import decide, leakage, metrics, neardup, sampling, spatial, splits, typed, validation
from gristmill.operators.graph import connected_components


def one(df):
    return df.first()[0]


def test_golden_typed_answers(spark):
    rows = [("a", "s", "urgent", "noul", "?", []), ("a", "s", "pick", "choice", "?", [("x", "X"), ("y", None)]), ("a", "s", "level", "score", "?", [("0", "low"), ("1", "mid"), ("2", "high")])]
    df = spark.createDataFrame(rows, "id string, state string, name string, kind string, instructions string, options array<struct<key:string,text:string>>")
    out = {r["name"]: r for r in decide.evaluate(df, lambda s, q, o: [i + 1 for i in range(len(o))]).collect()}
    assert out["urgent"]["value"] == pytest.approx(2 / 3, abs=1e-6)
    assert out["pick"]["choice"] == "y"
    assert out["level"]["value"] == pytest.approx(4 / 3, abs=1e-6)
    flat = {r["name"]: r for r in decide.evaluate(df, lambda s, q, o: [1] * len(o)).collect()}
    assert flat["urgent"]["value"] == 0.5 and flat["pick"]["choice"] == "x" and flat["pick"]["confidence"] == 0


def test_255_options(spark):
    options = [(str(i), None) for i in range(255)]
    df = spark.createDataFrame([("a", "s", "n", "choice", "?", options)], "id string, state string, name string, kind string, instructions string, options array<struct<key:string,text:string>>")
    p = decide.evaluate(df, lambda s, q, o: [1.0] * len(o)).first()["probabilities"]
    assert len(p) == 255 and sum(p) == pytest.approx(1)


def test_scorer_errors_surface(spark):
    df = spark.createDataFrame([("a", "s", "n", "choice", "?", [("x", None), ("y", None)])], "id string, state string, name string, kind string, instructions string, options array<struct<key:string,text:string>>")
    with pytest.raises(Exception, match="one finite weight"):
        decide.evaluate(df, lambda s, q, o: [float("nan")] * len(o)).collect()


def test_prediction_problems(spark):
    df = spark.sql("SELECT array('a','b') AS o, explode(array(map('a', 1D, 'b', 2D), map('a', 1D), map('a', 1D, 'b', 2D, 'c', 3D), map('a', 1D, 'b', double('nan')))) AS s")
    assert [r[0] for r in df.select(validation.prediction_problems(F.col("o"), F.col("s"))).collect()] == [None, "missing_key", "extra_key", "not_finite"]


def test_full_mod_matches_big_integers(spark):
    import hashlib

    rows = spark.range(50).select("id", hashing.full_mod(hashing.digest("id"), 100).alias("m")).collect()
    assert all(r["m"] == int(hashlib.sha256(str(r["id"]).encode()).hexdigest(), 16) % 100 for r in rows)


def test_normalised_unicode(spark):
    df = spark.createDataFrame([("  A　B\x1cßC ",)], "t string")
    assert one(df.select(hashing.normalised("t", unicode=True))) == "a b ssc"


def test_round_robin_equals_loop(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("st"), rnd.choice("abc")) for i in range(120)]
    got = {(r["source"], r["k"]): r["id"] for r in sampling.round_robin(spark.createDataFrame(rows, "id int, source string, label string"), "source", "label", ["id"], 25).collect()}
    for source in "st":
        queues = {x: sorted(i for i, s, l in rows if s == source and l == x) for x in "abc"}
        out = []
        while len(out) < 25 and any(queues.values()):
            for x in "abc":
                if queues[x] and len(out) < 25:
                    out.append(queues[x].pop(0))
        assert [got[(source, k + 1)] for k in range(len(out))] == out


def test_interleave_takes_each_once(spark):
    df = spark.createDataFrame([(i, "s", (i * 7) % 13, f"{(i * 5) % 11:02d}") for i in range(30)], "id int, s string, hard int, h string")
    out = sampling.interleave(df, "s", "id", "hard", "h", 12).orderBy("turn").collect()
    ids = [r["id"] for r in out]
    assert len(set(ids)) == 12 and ids[0] == max(range(30), key=lambda i: ((i * 7) % 13, -i))


def test_hamming_pairs_equal_brute_force(spark):
    rnd = random.Random(5)
    codes = [(i, rnd.getrandbits(12)) for i in range(200)] + [(300, 5), (301, 5)]
    got = {(r["a"], r["b"], r["distance"]) for r in neardup.hamming_pairs(spark.createDataFrame(codes, "id long, code long"), "id", "code", 12, 2).collect()}
    want = {(min(i, j), max(i, j), (a ^ b).bit_count()) for x, (i, a) in enumerate(codes) for j, b in codes[:x] if (a ^ b).bit_count() <= 2}
    assert got == want


def test_components_on_a_long_path_and_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[200] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_owner_split_is_one_pass(spark):
    df = spark.createDataFrame([(1, "train", "k"), (2, "test", "k"), (3, "train", "j"), (4, "dev", None)], "id int, split string, key string")
    assert {r["id"] for r in leakage.owner_split(df, "id", {"key": F.col("key")}).collect()} == {2, 3, 4}


def test_multi_key_anti_cleans_train_only(spark):
    df = spark.createDataFrame([(1, "train", "a", "x"), (2, "dev", "a", "y"), (3, "test", "a", "z"), (4, "train", "b", "z"), (5, "train", "c", "w")], "id int, split string, k string, j string")
    assert {r["id"] for r in leakage.multi_key_anti(df, "id", {"k": F.col("k"), "j": F.col("j")}).collect()} == {2, 3, 5}


def test_greedy_boxes_do_not_overlap(spark):
    rows = [(1, 0, "a", 0.0, 0.0, 1.0, 1.0), (1, 1, "a", 5.0, 0.0, 2.0, 2.0), (1, 2, "a", 5.1, 0.0, 2.0, 2.0), (1, 3, "b", 9.0, 9.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, element int, role string, l double, t double, w double, h double")
    assert [r["element"] for r in spatial.greedy_distinct(df, "g", F.col("element") == 0, 3).orderBy("place").collect()] == [1, 3]


def test_rotate_and_options(spark):
    df = spark.sql("SELECT array('a','b','c') AS v, array() AS e")
    assert one(df.select(vectors.rotate(F.col("v"), F.lit(2)))) == ["c", "a", "b"]
    options, gold = typed.choice(F.col("v"), F.lit("b"))
    assert one(df.select(gold)) == "B" and typed.all_rotations(df, "v").count() == 3 and typed.all_rotations(df, "e").count() == 0


def test_rare_class_moves_first_group(spark):
    df = spark.createDataFrame([("g1", "train", True), ("g2", "train", True), ("g3", "test", False)], "g string, split string, rare boolean")
    out = {r["g"]: r["split"] for r in splits.move_rare(df, "g", F.col("rare"), rank=F.col("g")).collect()}
    assert out == {"g1": "calibration", "g2": "train", "g3": "test"}


def test_invariants(spark):
    from gristmill.operators.schema import DECISION

    q = {"type": "choice", "instructions": "?", "options": [{"key": "A", "text": "x"}, {"key": "B", "text": "y"}]}
    def row(i, **k):
        return {**{f.name: None for f in DECISION}, "id": i, "split": "train", "modality": "text", "source": {"repo": "r", "group": "g"}, "question": q, "gold": {"key": "A"}, **k}

    assert validation.invariant_violations(spark.createDataFrame([row("1")], DECISION)).count() == 0
    bad = {r["rule"] for r in validation.invariant_violations(spark.createDataFrame([row("1"), row("1", gold={"key": "Z"}, split="dev", modality="image")], DECISION)).collect()}
    assert bad == {"gold_not_option", "media_missing", "duplicate_id", "group_in_splits"}


def test_temperature_recovers_scale(spark):
    df = spark.createDataFrame([([0.0, 4.0], 1)] * 7 + [([0.0, 4.0], 0)] * 3, "z array<double>, target int").withColumn("g", F.lit("g"))
    r = metrics.fit_temperature(df, ["g"], "z", "target", 3).first()
    assert r["at_boundary"] and r["temperature"] == 4.0  # ln(7/3) = 0.85 = 4 / t lies beyond the grid


def test_gate_stops(spark):
    df = spark.range(1)
    assert validation.gate(df, "no", F.lit(True)).count() == 1
    with pytest.raises(Exception, match="nope"):
        validation.gate(df, "nope", F.col("id") > 5).collect()


def test_interleave_equals_a_literal_merge(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice("st"), rnd.randrange(8), f"{rnd.randrange(10**6):06d}") for i in range(90)]
    for take in (7, 25, 100):
        got = {}
        for r in sampling.interleave(spark.createDataFrame(rows, "id int, s string, hard int, h string"), "s", "id", "hard", "h", take).collect():
            got.setdefault(r["s"], {})[r["turn"]] = r["id"]
        for s in "st":
            own = [r for r in rows if r[1] == s]
            hard, diverse = sorted(own, key=lambda r: (-r[2], r[0])), sorted(own, key=lambda r: (r[3], r[0]))
            out, at = [], [0, 0]
            while len(out) < min(take, len(own)):
                queue, k = ((hard, 0), (diverse, 1))[len(out) % 2]
                while queue[at[k]][0] in out:
                    at[k] += 1
                out.append(queue[at[k]][0])
            assert [got[s][i] for i in range(len(out))] == out and len(got[s]) == len(out)


def test_ranks_of_a_hot_key(spark):
    rows = [(i, "hot" if i % 4 else f"k{i % 5}", (i * 7919) % 1009) for i in range(1000)] + [(2000, None, 3), (2001, None, 1)]
    for partitions in (1, 13):
        got = {r["id"]: r["rank"] for r in sampling.ranked(spark.createDataFrame(rows, "id int, k string, o int"), ["k"], ["o"], "rank", partitions).collect()}
        assert len(got) == len(rows)
        for key in {k for _, k, _ in rows}:
            assert [got[i] for i, k, o in sorted((r for r in rows if r[1] == key), key=lambda r: r[2])] == list(range(sum(k == key for _, k, _ in rows)))


def test_distractors_reach_beyond_the_first_bucket(spark):
    # All but three of 400 texts are of the rows' own group, so most buckets have none that fits.
    from gristmill.operators.distractors import from_other_groups

    rows = [(i, "big", f"t{i}") for i in range(397)] + [(900, "x", "a"), (901, "y", "b"), (902, "x", "c"), (903, "x", "t5"), (904, "big", None)]
    got = {}
    for r in from_other_groups(spark.createDataFrame(rows, "id int, g string, t string"), "id", "g", "t", 3).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["t"]
    assert all(sorted(got[i]) == [1, 2, 3] and set(got[i].values()) <= {"a", "b", "c", "t5"} - {f"t{i}"} for i in range(397)) and set(got[5].values()) == {"a", "b", "c"}
    assert all(len(set(got[i].values())) == 3 for i in got) and "a" not in got[900].values() and len(got[904]) == 3


def test_bootstrap_is_that_of_a_literal_loop(spark):
    rnd = random.Random(4)
    rows = [(i, i % 60, rnd.randrange(2), int(rnd.random() < 0.6)) for i in range(400)]
    wide = spark.createDataFrame(rows, "id int, c int, a int, b int")
    for cluster, at in (("id", 0), ("c", 1)):
        groups = {}
        for r in rows:
            groups.setdefault(r[at], []).append(r[3] - r[2])
        names, means = list(groups), []
        for _ in range(2000):
            drawn = [x for n in rnd.choices(names, k=len(names)) for x in groups[n]]
            means.append(sum(drawn) / len(drawn))
        means.sort()
        got = metrics.order_interval(metrics.cluster_bootstrap(wide, cluster)).first()
        assert got["resamples"] == 2000 and got["low"] == pytest.approx(means[50], abs=0.012) and got["high"] == pytest.approx(means[1949], abs=0.012)


def test_texts(spark):
    from gristmill.functions import texts

    df = spark.createDataFrame([("PlayingGuitar2Solo", '{"b": [1, {"z": 1, "a": "é"}], "a": null}'), ("YoYo", '"plain"'), (None, None)], "l string, j string")
    assert [tuple(r) for r in df.select(texts.display_label(F.col("l")), texts.canonical_text(F.col("j"))).collect()] == [("Playing Guitar2 Solo", '{"a": null, "b": [1, {"a": "é", "z": 1}]}'), ("Yo-Yo", "plain"), (None, None)]
    a = spark.sql("SELECT array(array(1, 2, 3), array(1, 2, 4), array(1, 2)) AS x, array(array(1), array(2)) AS y, cast(array() AS array<array<int>>) AS z, array('a b', 'b c', NULL) AS o")
    assert tuple(a.select(*[texts.common_prefix(F.col(c)) for c in "xyz"], F.round(texts.likeness(F.col("o")), 6), F.round(texts.softcap(F.lit(100.0), 30.0), 4)).first()) == (2, 0, 0, 0.363333, 29.9237)


def test_prior_is_subtracted_before_the_pick(spark):
    """The second logit is larger by less than its exponential shows."""
    a, b = 0.1 + 0.2, 0.3
    df = spark.createDataFrame([([b, a, 0.0], [0.0, 0.0, 0.0])], "z array<double>, q array<double>")
    row = decide.minus_prior(df, "z", "q", [1.0]).first()
    assert a > b and row["p"][0] == row["p"][1] and row["pick"] == 1
