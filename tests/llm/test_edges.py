"""Defined cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gristmill.llm import bm25, bpe, exact_dedup, line_dedup, ngram_join, packing, pii, quality, secrets, substring_dedup

BPE = public_tokenizers.path("word_bpe_49k.json")
LONG = "word " * 60_000 + "end."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, mark string, node string, score double, kept string"
ROWS = [
    (1, None, None, None, None), (2, "", "en", None, 0), (3, "   \n\t\n", "en", "s", 3), (4, LONG, "en", "s", 1), (4, LONG, "en", "s", 1),
    (None, "null id text of a few words here", "en", "t", 2), (None, None, None, None, None), (5, "Same text AND more words here to see", "en", "t", 3), (6, "same text and more words HERE to see", "de", "u", 3),
    (5, "another text under the same id as before", "en", "t", 3), (2**62, "token = \"abcdefgh12345678\" and é日本 ßÄ", "xx", "v", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "d", "m", "n", 0.5, "k") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, 0), (4, None, 0), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")


EVERY = {
    "exact": lambda d: exact_dedup.dedup(d, F.col("doc_id") % 2 == 0),
    "line": line_dedup.dedup_lines,
    "secrets": secrets.scan_report,
    "redact": secrets.redact,
    "pack": lambda d: packing.pack(d, BPE),
    "bpe": lambda d: bpe.code_report(d, BPE),
    "join": ngram_join.join,
    "pii": lambda d: pii.pseudonymise(d, b"k"),
    "substring": substring_dedup.dedup,
}


@pytest.mark.parametrize("name", EVERY)
def test_odd_rows(docs, name):
    rows = EVERY[name](docs).collect()
    if name == "pack":
        assert len({(r["doc_id"], r["start"], r["ids_crc32"]) for r in rows}) >= len(ROWS) - 3
    else:
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize("name", EVERY)
def test_empty_table(empty, name):
    assert EVERY[name](empty).collect() == []


def test_quality_odd_rows(docs, empty, labels):
    rows = quality.quality_report(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality_report(empty, labels).collect() == []
    none = quality.quality_report(docs, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert set(quality.keep_good(docs, labels).columns) == set(docs.columns)


def test_names_that_clash(spark, labels):
    """Columns with the names that the operators use inside come back as they were."""
    names = ["_doc", "_mark", "_quality_score", "quality_score", "own", "Mark", "hit", "spans", "cut", "lost", "bitmap", "keep", "n", "node", "_text", "_n", "repeats", "copy"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    line = "This very line stands in more than five of these documents"
    docs = spark.createDataFrame([(i, f"{line}\nsecret = 'abcdefgh1234' number {i} of some words", "en", "s", *(f"{n}{i}" for n in names)) for i in range(7)], schema)
    results = {
        "line": line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs)).drop("_n_lines", "_n_dropped"),
        "redact": secrets.redact(docs),
        "quality": quality.keep_good(docs, labels.where("false")),
        "join": ngram_join.keep_one(docs),
    }
    for name, frame in results.items():
        assert frame.columns == docs.columns, name
        rows = frame.collect()
        assert len(rows) == 7 and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name


def test_search_odd_rows(docs, empty):
    found = bm25.search(docs, docs, k=3).collect()
    assert found and all(r["query_id"] is not None and r["doc_id"] is not None for r in found)
    assert bm25.search(docs, F.col("doc_id") == 6, k=3).count() == 3 and bm25.search(empty, F.lit(True)).count() == 0
    assert bm25.search(empty, docs).collect() == [] and bm25.search(docs, empty).collect() == []


def test_exact_defined_cases(docs):
    rows = exact_dedup.dedup(docs, F.lit(False)).collect()
    blank = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert len(blank) == 3 and {r["keep_id"] for r in blank} == {2} and {r["group_size"] for r in blank} == {3}
    same = {r["doc_id"]: r for r in rows if r["group_size"] == 2 and r["keep_id"] == 6}
    assert set(same) == {5, 6} and same[6]["kept"] and not same[5]["kept"]
    lone = [r for r in rows if r["doc_id"] is None and r["group_size"] == 1]
    assert len(lone) == 1 and lone[0]["keep_id"] is None and lone[0]["kept"]


def test_join_defined_cases(docs):
    rows = [(r["doc_id"], r["class_id"]) for r in ngram_join.join(docs).collect()]
    assert (6, 5) in rows and (5, 5) in rows and (1, 1) in rows and (2, 2) in rows and (3, 3) in rows


def test_keep_one_keeps_one_row(docs):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and 6 not in ids and ids.count(5) == 2


def test_bpe_special_and_long():
    enc = bpe.Encoder(BPE, words_kept=200, chunk_bytes=16, chunk_cache_bytes=4000)
    texts = ["", " ", "x" * 9000, "<|endoftext|>" * 300 + " <|ENDOFTEXT|>", "a\x1cb\x85c\x01 d", "é é İ Σς ﬁ", "日本語" * 500, "it's we'll 'S, x.y, Z." * 200, LONG]
    for t in texts:
        want = enc.tok.encode(t, add_special_tokens=False).ids
        got = np.frombuffer(enc.encode_chunked([t.encode()])[0], dtype="<u4").tolist()
        assert got == want, t[:40]
        assert np.frombuffer(enc.encode_many([t.encode()])[0], dtype="<u4").tolist() == want
        assert enc.decode(np.array(want, dtype="<u4").tobytes()) == enc.tok.decode(want, skip_special_tokens=False)


def test_bpe_reuses_chunks_of_other_documents():
    rnd = __import__("random").Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 9)))
    passage = " ".join(word() for _ in range(400))
    texts = [" ".join([*(word() for _ in range(rnd.randrange(60))), passage, word()]).encode() for _ in range(40)]
    enc = bpe.Encoder(BPE, chunk_bytes=128)
    for t in texts:  # one at a time: reuse is through the cache, not within a batch
        assert np.frombuffer(enc.encode_chunked([t])[0], dtype="<u4").tolist() == enc.tok.encode(t.decode(), add_special_tokens=False).ids
    assert enc.reused > 0.6 * enc.met and enc.repaired > 0
    small = bpe.Encoder(BPE, chunk_bytes=128, chunk_cache_bytes=6000)  # most chunks are gone when they come again
    assert [small.encode_chunked([t]) for t in texts] == [enc.encode_chunked([t]) for t in texts] and len(small.chunks) + len(small.older) < 20


@pytest.mark.parametrize("text", ["abcdefghij" * 100_000, "日本語文字列処理、。" * 33_000, "ab12," * 200_000, "9f" * 300_000])
def test_bpe_time_without_blanks(text):
    import time

    enc = bpe.Encoder(BPE)
    began = time.perf_counter()
    want = enc.tok.encode(text, add_special_tokens=False).ids
    library = time.perf_counter() - began
    began = time.perf_counter()
    got = enc.encode_chunked([text.encode()])[0]
    assert time.perf_counter() - began < 2 * library + 1
    assert np.frombuffer(got, dtype="<u4").tolist() == want


def test_bpe_probes_what_it_relies_on(tmp_path):
    import json

    with open(BPE) as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"] = [n for n in spec["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(spec))
    enc = bpe.Encoder(str(path))
    assert not enc.lowers
    for t in ("Hello World, ABC", "the End. AB, c " * 300):
        assert np.frombuffer(enc.encode_chunked([t.encode()])[0], dtype="<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_bpe_other_tokenizer_falls_back():
    enc = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Hello  world,\n this is <|endoftext|> it.  "
    want = enc.tok.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode_chunked([text.encode()])[0], dtype="<u4").tolist() == want
    assert enc.decode(np.array(want, dtype="<u4").tobytes()) == enc.tok.decode(want, skip_special_tokens=False)
