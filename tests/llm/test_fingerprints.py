"""Fingerprints against plain Python: sums of paragraph vectors, edits, neighbours, and what likeness says."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import fingerprints
from gristmill.llm.fingerprints import LANES, SKETCH, WINDOW, Fingerprint
from gristmill.llm.queries import QUERIES

TEXTS = st.lists(st.text(alphabet="abé日 \n", max_size=40), max_size=6).map("\n".join)


def by_hand(text: str, stretch: int = 1 << 18) -> str:
    """Lane by lane and window by window, in Python integers; windows by their counts in each paragraph's stretches."""
    lanes, sketch = [0] * LANES, [0] * SKETCH
    cut = (1 << 64) - 1
    for p in text.encode().split(b"\n"):
        d = hashlib.shake_128(p).digest(8 * LANES)
        lanes = [(a + int.from_bytes(d[8 * i : 8 * i + 8], "little")) & cut for i, a in enumerate(lanes)]
        seen = Counter()
        for e in range(1, len(p) + 1):
            w = p[max(0, e - WINDOW) : e].rjust(WINDOW, b"\0")
            x = int.from_bytes(w[8:], "little") * 0x9E3779B97F4A7C15 & cut
            x ^= x >> 29
            x = (x + int.from_bytes(w[:8], "little")) * 0xBF58476D1CE4E5B9 & cut
            x = (x ^ x >> 32) * 0x94D049BB133111EB & cut
            seen[(e - 1) // stretch, x] += 1
        for (_, x), count in seen.items():
            sketch[(x >> 54) % SKETCH] += round(math.sqrt(count)) * (1 if x >> 54 < SKETCH else -1)
    raw = b"".join(v.to_bytes(8, "little") for v in lanes) + b"".join((v & 0xFFFF).to_bytes(2, "little") for v in sketch)
    return base64.b64encode(raw).decode()


@given(TEXTS)
@settings(max_examples=80, deadline=None)
def test_against_plain_python(text):
    assert str(Fingerprint.of(text.encode())) == by_hand(text)


def test_long_texts_by_slices(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("ab cé\n") if i % 3000 < 2000 else rng.choice("ab ") for i in range(9000))
    for size in (64, 257, 1000, 20_000):
        monkeypatch.setattr(fingerprints, "SLICE", size)
        assert str(Fingerprint.of(text.encode())) == by_hand(text, size)
        assert Fingerprint.of(("x\n" + text).encode()) - Fingerprint.of(b"x") == Fingerprint.of(text.encode())


@given(st.lists(st.text(alphabet="abc é", max_size=20), min_size=1, max_size=8), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_order_free_insertion_and_deletion(paragraphs, rng):
    f = Fingerprint.of("\n".join(paragraphs).encode())
    other = paragraphs[:]
    rng.shuffle(other)
    assert Fingerprint.of("\n".join(other).encode()) == f
    grown = f + Fingerprint.of(b"new one")
    assert grown == Fingerprint.of("\n".join([*paragraphs, "new one"]).encode()) and grown != f
    assert grown - Fingerprint.of(b"new one") == f == Fingerprint.parse(str(f))
    once = Fingerprint.of("\n".join([*paragraphs, paragraphs[0]]).encode())
    assert once != f and once - Fingerprint.of(paragraphs[0].encode()) == f


@given(TEXTS, TEXTS)
@settings(max_examples=80, deadline=None)
def test_edits_equal_a_new_fingerprint(a, b):
    share = len(a) // 4
    text, changed = fingerprints.edited(Fingerprint.of(a.encode()), a, len(a) - share, b[:share])
    assert text == a[: len(a) - share] + b[:share] and changed == Fingerprint.of(text.encode())


def check(spark, rows, partitions):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, piece string, guest int").repartition(5)
    got = fingerprints.with_next(docs, partitions).collect()
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    if len({d for d, _ in rows}) < len(rows):
        return  # repeated ids: every row has a row
    for i, (d, t) in enumerate(rows):
        (r,) = by_id[d]
        nxt = rows[(i + 1) % len(rows)][1]
        share = len(t) // 4
        new = t[: len(t) - share] + nxt[:share]
        f, g, h = (Fingerprint.of(x.encode()) for x in (t, new, nxt))
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == str(f) and r["edited_fingerprint"] == str(g)
        assert r["near_edited"] == f.likeness(g) and r["near_next"] == f.likeness(h)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_neighbours(spark, partitions):
    rng = random.Random(partitions)
    word = lambda: "".join(rng.choice("abcdé\n ") for _ in range(rng.randrange(30)))
    check(spark, [(i * 7, word()) for i in range(60)], partitions)
    check(spark, [(None, "none"), (2**62, None), (-5, "")], partitions)
    check(spark, [(1, "alone here")], partitions)
    check(spark, [(None, "a"), (None, "b"), (3, "c"), (3, "c"), (3, "d"), (4, "long " * 80_000)], partitions)
    assert fingerprints.with_next(spark.createDataFrame([], "doc_id long, text string"), partitions).count() == 0


def test_repeated_ids_are_neighbours(spark):
    rows = [(1, "same text of one id"), (1, "same text of one id"), (2, "another text")]
    got = sorted((r["doc_id"], r["near_next"]) for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert [d for d, _ in got] == [1, 1, 2] and [n for d, n in got if d == 1].count(1.0) == 1


def test_query_and_what_likeness_says(spark):
    """Whole table: every digest again, edited texts are near, unlike neighbours are not."""
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in QUERIES["op13_fingerprints"](spark, sf).collect()}
    assert sorted(got) == ids
    for i, d in enumerate(ids):
        t, nxt, r = texts[d], texts[ids[(i + 1) % len(ids)]], got[d]
        new = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r["fingerprint"] == by_hand(t) if len(t) < 2000 else str(Fingerprint.of(t.encode()))
        assert r["edited_fingerprint"] == str(Fingerprint.of(new.encode()))
    long = [r for r in got.values() if r["n_chars"] >= 200]
    assert np.quantile([r["near_edited"] for r in long], 0.02) > 0.6
    assert np.median([r["near_next"] for r in long]) < 0.2


def test_merged_groups(spark):
    rows = [(i % 3 if i % 5 else None, f"p{i}\nq") for i in range(50)]
    docs = spark.createDataFrame(rows, "g int, text string")
    got = {r["g"]: r["fingerprint"] for r in fingerprints.merged(fingerprints.fingerprints(docs), ["g"]).collect()}
    for g in {g for g, _ in rows}:
        assert got[g] == str(Fingerprint.of("\n".join(t for k, t in rows if k == g).encode()))
    assert fingerprints.merged(fingerprints.fingerprints(docs.where("false")), ["g"]).count() == 0
