"""Components grown in batches against one run over all edges, and splits that stay."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import graph


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in list(up)}


SPLIT = lambda c: F.when(c % 3 == 0, "test").otherwise("train")


def split(c):
    return "test" if c % 3 == 0 else "train"


@pytest.mark.parametrize("seed,hub", [(1, False), (2, True)])
def test_batches_give_the_components_of_one_run(spark, tmp_path, seed, hub):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(401, 401)]
    if hub:
        edges += [(500, i) for i in range(600, 1400)]
        rng.shuffle(edges)
    forest, state = None, {}  # component: (split, batch)
    for batch in range(3):
        some = edges[batch::3]
        before = union_find([e for i in range(batch) for e in edges[i::3]])
        forest, conflicts = graph.grow(forest, spark.createDataFrame([*some, (None, 3)], "a long, b long"), batch, SPLIT)
        forest.save(f"{tmp_path}/{batch}")
        forest = graph.Forest.load(spark, f"{tmp_path}/{batch}")
        want = union_find([e for i in range(batch + 1) for e in edges[i::3]])
        assert {r["node"]: r["component"] for r in forest.nodes.collect()} == want
        after, lost = {}, set()
        for c in set(want.values()):
            olds = sorted({(state[before[n]][1], before[n]) for n in want if want[n] == c and n in before})
            kept = (state[olds[0][1]][0], olds[0][0]) if olds else (split(c), batch)
            after[c] = kept
            lost |= {(c, kept[0], o, state[o][0]) for _, o in olds if state[o][0] != kept[0]}
        assert {r["component"]: (r["split"], r["batch"]) for r in forest.components.collect()} == after
        assert {tuple(r) for r in conflicts.collect()} == lost
        assert sum(r["size"] for r in forest.components.collect()) == len(want)
        state = after


def test_untouched_trees_are_not_contracted(spark, monkeypatch):
    forest, _ = graph.grow(None, spark.createDataFrame([(i, i + 1) for i in range(0, 400, 2)], "a long, b long"), 0, SPLIT)
    seen = []
    whole = graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda e, *x: (seen.append(e.count()), whole(e, *x))[1])
    forest, conflicts = graph.grow(forest, spark.createDataFrame([(1, 3), (900, 3)], "a long, b long"), 1, SPLIT)
    assert seen == [2] and forest.components.count() == 199 and conflicts.count() == 1
    same, none = graph.grow(forest, spark.createDataFrame([], "a long, b long"), 2, SPLIT)
    assert same.nodes.count() == forest.nodes.count() and none.count() == 0


def test_text_nodes(spark):
    forest, _ = graph.grow(None, spark.createDataFrame([("d:1", "k:x"), ("d:2", "k:x")], "a string, b string"), 0, lambda c: F.lit("train"))
    assert {r["component"] for r in forest.nodes.collect()} == {"d:1"}
