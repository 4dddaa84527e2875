"""Substring dedup against a version of its own here, word by word, and its recall on planted passages."""

import random
import re

import pytest
import xxhash

from gristmill.llm import substring_dedup


def units(words):
    """Word ranges of the sentences, as the module's docstring says it, in plain loops."""
    hashed = [xxhash.xxh3_64_intdigest(w) // 2 * 2 + (w[-1] in ".!?") for w in words]
    out, begin = [], 0
    for i, w in enumerate(words):
        if w[-1] in ".!?" or i == len(words) - 1:
            cuts = {i + 1}
            if i + 1 - begin > 8:
                for j in range(len(words) - 7):
                    least = min(range(j, j + 8), key=lambda k: (hashed[k], k))
                    if begin <= least <= i:
                        cuts.add(least + 1)
            for c in sorted(cuts):
                out.append((begin, c))
                begin = c
    return out


def brute(rows):
    """Every row's text without what a span before it holds; rows in the order of their id and text mark."""
    seen, out = set(), []
    for _, text in rows:
        words = (text or "").lower().split()
        cut, gone, runs = units(words), set(), []
        for k in range(len(cut)):
            end = next((e for e in range(k + 3, len(cut) + 1) if cut[e - 1][1] - cut[k][0] >= 30), None)
            if end is None:
                break
            runs.append((k, end))
        if runs and runs[-1][1] < len(cut):
            runs.append((runs[-1][0], len(cut)))
        for k, end in runs:
            span = tuple(words[cut[k][0] : cut[end - 1][1]])
            if span in seen:
                gone |= set(range(k, end))
            seen.add(span)
        at = [m.start() for m in re.finditer(r"\S+", text or "")]
        begins = [at[a] if a else 0 for a, _ in cut] + [len(text or "")]
        out.append((text if not gone else "".join(text[begins[k] : begins[k + 1]] for k in range(len(cut)) if k not in gone), len(gone)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Word,", "é!", "x.y"]
    word = lambda p: rnd.choice(vocabulary) + ("." if rnd.random() < p else "")
    passages = [" ".join(word(p) for _ in range(60)) for p in (0.1, 0.02, 0.3, 0)]
    rows = []
    for i in range(120):
        words = [word(rnd.choice([0.1, 0.02])) for _ in range(rnd.randrange(0, 90))]
        for _ in range(rnd.choice([0, 1, 1, 2])):
            words.insert(rnd.randrange(len(words) + 1), rnd.choice(passages[:2] if rnd.random() < 0.7 else passages))
        rows.append((i, rnd.choice([" ", "  ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_word_by_word(spark, seed):
    rows = corpus(seed)
    want = {i: x for (i, _), x in zip(rows, brute(rows))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring_dedup.dedup(docs).collect()} == want
    assert sum(n > 0 for _, n in want.values()) > 20
    # Hashes that go over many partition edges are settled alike.
    for partitions in (1, 7, 97):
        got = {r["doc_id"]: sorted(r["repeats"]) for r in substring_dedup.repeated_spans(docs, partitions=partitions).collect()}
        assert set(got) == {i for i, (_, n) in want.items() if n}
        assert partitions == 1 or got == once
        once = got


def test_repeated_rows_keep_one_text(spark):
    text = " ".join(f"w{i}" for i in range(80)) + "."
    docs = spark.createDataFrame([(1, text), (1, text), (1, text), (2, text), (None, None), (None, None), (3, "short"), (3, "short")], "doc_id long, text string")
    for partitions in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows = [(r["doc_id"], r["text"], r["n_removed"] > 0) for r in substring_dedup.dedup(docs).collect()]
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(rows) == 8 and sorted(r for r in rows if r[0] == 1 and not r[2]) == [(1, text, False)]
        left = [t for i, t, cut in rows if cut]
        assert left == [""] * 3
        assert rows.count((3, "short", False)) == 2 and rows.count((None, None, False)) == 2


def test_whole_copies_leave_no_word(spark):
    """On the driver's texts: of every text that has a span, an exact later copy is cut to nothing."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    some = sorted({t for t in texts if len(substring_dedup.spans([t.lower().split()])[0])})
    docs = spark.createDataFrame([(i + k * 10_000, t) for k in (0, 1) for i, t in enumerate(some)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(docs).collect()}
    assert len(some) > 100 and all(got[i + 10_000] == "" for i in range(len(some)))


def planted(seed, n, length):
    """Pairs of texts, partly without stops, that share one passage of ``length`` words and nothing else."""
    rnd = random.Random(seed)
    for _ in range(n):
        p = rnd.choice([0, 0.03, 0.1, 0.3])
        word = lambda: f"w{rnd.randrange(10**6)}" + "." * (rnd.random() < p)
        passage = [word() for _ in range(length)]
        yield passage, *([word() for _ in range(rnd.randrange(40))] + passage + [word() for _ in range(rnd.randrange(40))] for _ in range(2))


def test_every_planted_passage_shares_a_span():
    for length in (51, 52, 60):
        for passage, a, b in planted(length, 700, length):
            assert len(set(substring_dedup.spans([a])[1].tolist()) & set(substring_dedup.spans([b])[1].tolist())), passage


def test_every_later_copy_is_cut(spark):
    pairs = list(planted(3, 400, 51))
    docs = spark.createDataFrame([(2 * i + k, " ".join(t)) for i, (_, *both) in enumerate(pairs) for k, t in enumerate(both)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split() for r in substring_dedup.dedup(docs).collect()}
    for i, (passage, a, b) in enumerate(pairs):
        assert got[2 * i] == a
        left = set(got[2 * i + 1])
        assert len(left & set(passage)) <= len(passage) - substring_dedup.MIN_WORDS
        assert set(b) - set(passage) <= left
