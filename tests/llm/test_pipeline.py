"""The pipeline stage by stage, each against a brute-force version over its own input."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import line_dedup, quality, secrets

from .test_exact import brute_spans, near

SF = "/root/testdata/sf0.001"
ORDER = ["quality classifier", "line dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage, with a few planted documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.where("length(text) > 900").orderBy("doc_id").first()["text"]
    token = "Qw3rtyLiveKey0099zzXX"
    planted = [(90_001, text + f" See {token} there.", "en", "p", 1), (90_002, text + f" See {token} here.", "en", "p", 1), (90_003, "Call me. password = hunter2hunter2 " + text[::-1], "en", "p", 1)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    root, out = tmp_path_factory.mktemp("stages"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(root / str(i))
        stage(spark, docs, SF).write.parquet(path)
        done = spark.read.parquet(path)
        out.append((name, docs.collect(), done.collect(), done.columns))
        docs = done
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ORDER == [n for n, _ in corpus_pipeline.STAGES]
    assert all(s[3] == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:-1])


def test_quality_stage(spark, stages):
    _, before, after, _ = stages[0]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.scores([r["text"].encode() for r in before], model.compressors() if model.good is not None else None)
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, s in zip(before, scores) if s >= 0.5)


def test_line_stage(stages):
    _, before, after, _ = stages[1]
    holders = defaultdict(set)
    for r in before:
        for line in r["text"].split("\n"):
            holders[line_dedup.line_key(line)].add(r["doc_id"])
    def kept(r):
        return "\n".join(x for x in r["text"].split("\n") if not (len(k := line_dedup.line_key(x)) >= 40 and len(holders[k]) >= 5 and max(holders[k]) != r["doc_id"]))

    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in after) == sorted((r["doc_id"], kept(r), len(kept(r))) for r in before)


def test_join_stage(stages):
    _, before, after, _ = stages[2]
    _, _, group = near({r["doc_id"]: r["text"] for r in before})
    assert sorted(r["doc_id"] for r in after) == sorted(set(group.values())) and len(after) < len(before)


def test_secret_stage(stages):
    _, before, after, _ = stages[3]
    bare = re.compile(secrets.BARE)
    found, owners = {}, defaultdict(set)
    for r in before:
        t = r["text"]
        spans = []
        for a, k, b in brute_spans(t):
            value = re.search(r"[A-Za-z0-9+/_.=-]+$", t[a:b])[0] if k == 0 else t[a:b]
            if k == 0:
                value = re.fullmatch(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t[a:b])[1]
            spans.append((a, k, b, value))
        spans += [(m.start(), 3, m.end(), m[0]) for m in bare.finditer(t)]
        found[r["doc_id"]] = spans
        for s in spans:
            owners[s[3]].add(r["source"])
    def redacted(r):
        base = [s for s in found[r["doc_id"]] if s[1] < 3]
        spans = sorted([*base, *(s for s in found[r["doc_id"]] if s[1] == 3 and len(owners[s[3]]) == 1 and all(b[2] <= s[0] or s[2] <= b[0] for b in base))])
        out, at = [], 0
        for a, _, b, v in spans:
            if a >= at:
                out += [r["text"][at:a], "[EXAMPLE_KEY]" if len(owners[v]) >= secrets.COPIED_OWNERS else "[SECRET]"]
            at = max(at, b)
        return "".join([*out, r["text"][at:]])

    assert sorted((r["doc_id"], r["text"]) for r in after) == sorted((r["doc_id"], redacted(r)) for r in before)
    assert sum("[SECRET]" in r["text"] for r in after) >= 1


def test_packing_stage(stages):
    _, before, after, _ = stages[4]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    room = defaultdict(list)
    for r in after:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in room.values():
        ends = 0
        for offset, length in sorted(s):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(room) <= -(-sum(r["length"] for r in after) // 2048) + 1 or len(room) == len([r for r in after if r["length"] > 1024])


def test_run_stores_between_stages(spark):
    assert corpus_pipeline.run(spark, SF).agg(F.count("*")).first()[0] > 0 and corpus_pipeline.ORACLE_SQL is None


ODD = "doc_id long, text string, lang string, source string, n_chars long, mark string, _mark string, own string"


def test_stages_on_odd_rows(spark):
    words = "some words of a text that is long enough to be a sentence"
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, " \n\t", "en", "s"), (4, f"{words} four\n" * 9000, "en", "s"), (5, f"{words} five", "en", "s"), (5, f"{words} five", "en", "s"), (None, f"{words} null", "en", "s"), (None, None, "en", "s"), (6, "token = 'abcdefgh12345678' " + words, "en", "s"), (5, f"other {words}", "en", "s")]
    docs = spark.createDataFrame([(*r, 7, "m", "n", "o") for r in rows], ODD)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF).collect()
        if name == "line dedup":
            assert len(got) == len(rows) and sum(r["text"] is None for r in got) == 2
        if name == "n-gram Jaccard join":
            assert sorted(r["doc_id"] or 0 for r in got if (r["text"] or "").strip()) == [4, 5, 5, 6] and len(got) == 8
        if name == "secret scans":
            assert len(got) == len(rows) and [r["text"] for r in got if r["doc_id"] == 6] == [f"[SECRET]' {words}"]
        if name == "best-fit packing":
            assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 6, None} and sum(r["doc_id"] == 5 for r in got) == 3
        else:
            assert all(set(r.asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for r in got)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
