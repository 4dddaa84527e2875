"""Transaction logs against a replay record by record: the query, long transactions over many pieces, odd rows."""

import random
import zlib
from collections import defaultdict

import pytest

from gristmill.llm import transactions
from gristmill.llm.queries import QUERIES

LOG = "stream string, pos long, op string, key long, value long"


def one_by_one(records, per):
    """``(undone, states, store)`` of sorted ``stream, pos, op, key, value``."""
    streams, store, states, commits = defaultdict(lambda: ([], 0)), {}, [], 0
    undone = []
    state = lambda: states.append((len(states) + 1, len(store), sum(store.values())))
    for s, pos, op, key, value in records:
        held, saved = streams[s]
        if op == "change":
            held.append((pos, key, value))
        elif op == "savepoint":
            streams[s] = (held, len(held))
        elif op == "rollback":
            undone += [(p, k, "rollback", pos) for p, k, _ in held[saved:]]
            del held[saved:]
        elif op == "abort":
            undone += [(p, k, "abort", pos) for p, k, _ in held]
            streams[s] = ([], 0)
        else:
            for _, k, v in held:
                store.pop(k, None)
                if v is not None:
                    store[k] = v
            streams[s] = ([], 0)
            commits += 1
            if commits % per == 0:
                state()
    if commits % per:
        state()
    undone += [(p, k, "abort", None) for held, _ in streams.values() for p, k, _ in held]
    return undone, states, store


def compare(spark, records, per):
    found = transactions.replay(spark.createDataFrame(records, LOG).repartition(3))
    undone, states, store = one_by_one(sorted(records, key=lambda r: r[1]), per)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted((tuple(r) for r in found.undone.select("pos", "key", "kind", "by").collect()), key=key) == sorted(undone, key=key)
    assert sorted(tuple(r) for r in found.states(per).collect()) == states
    assert {r["key"]: r["value"] for r in found.store().collect()} == store


@pytest.mark.parametrize("ends,hot", [(3, 0.3), (0.02, 0.9), (0, 1)])
def test_random_logs(spark, ends, hot):
    """Transactions of a few records, of hundreds over many pieces, and one that the whole log is."""
    rng = random.Random(7)
    names, weights = ["commit", "abort", "savepoint", "rollback", "change"], [2 * ends / 3, ends / 3, 2, 2, 10]
    records = []
    for pos in rng.sample(range(10_000), 1500):
        op = rng.choices(names, weights)[0]
        stream = None if rng.random() < hot else rng.choice(["a", "b", "c"])
        records.append((stream, pos, op, rng.randrange(40) if op == "change" else None, rng.choice([None, rng.randrange(1 << 32)]) if op == "change" else None))
    compare(spark, records, 5)


def test_long_savepoint_chains(spark):
    """Changes kept by savepoints of other pieces share the fate of the transaction; later ones that of the rollback."""
    records = [("s", i, "savepoint" if i in (100, 700) else "rollback" if i in (650, 900) else "change", i % 7, i) for i in range(1000)]
    compare(spark, records, 64)
    compare(spark, [*records, ("s", 1000, "commit", None, None)], 64)
    compare(spark, [*records, ("s", 1000, "abort", None, None), ("s", 1001, "change", 1, 1)], 64)


def test_defined_cases(spark):
    empty = transactions.replay(spark.createDataFrame([], LOG))
    assert empty.undone.count() == empty.states(4).count() == empty.store().count() == 0
    rows = [("s", None, "change", 1, 1), ("s", 1, "merge", 1, 1), ("s", 2, "change", None, 5), ("s", 2, "change", None, None), ("s", 2, "change", None, 5), ("s", 3, "commit", None, None), (None, 3, "commit", None, None), (None, 4, "change", 9, 9)]
    found = transactions.replay(spark.createDataFrame(rows, LOG).withColumn("_part", transactions.F.lit("x")))
    assert [tuple(r) for r in found.states(1).orderBy("epoch").collect()] == [(1, 0, 0), (2, 1, 5)]
    assert [tuple(r) for r in found.undone.select("pos", "key", "kind", "by").collect()] == [(4, 9, "abort", None)]
    assert found.applied.count() == 3


def test_query_on_odd_documents(spark):
    """Null ids, texts and sources, repeated rows and labels, long texts, clashing names: the query against plain Python."""
    rows = [(i, None if i % 11 == 0 else f"é text {i}" * (1 + 4000 * (i == 40)), None if i % 3 == 0 else "s", "x") for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, "no id", "s", "x")], "doc_id long, text string, source string, op string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 400, 6)] * 2 + [(None, 1), (5, None)], "doc_id long, toxic int")
    records = []
    for i, text, source, _ in rows:
        h = zlib.crc32(str(i).encode())
        op = ["commit", "commit", "abort", "savepoint", "savepoint", "rollback", "rollback", *["change"] * 10][h % 17]
        key = h // 100 % 30000
        records.append((source, i, op, key, None if text is None or i % 6 == 0 else zlib.crc32(f"{key}:{text}".encode())))
    undone, states, _ = one_by_one(records, 8)
    got = {tuple(r) for r in transactions.reassembly(docs, labels, 8).collect()}
    assert got == {("state", *s) for s in states} | {(kind, p, by, k) for p, k, kind, by in undone}
    assert transactions.reassembly(docs.where("false"), labels).count() == 0


def test_query_has_rows(spark):
    assert QUERIES["op11_transactions"](spark, "/root/testdata/sf0.001").where("kind = 'state'").count() > 0
