"""Scans, sinks and streams on files of the test's own."""

import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill.sources import scans, sinks
from gristmill.streaming import incremental


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿text,label\n"two\nlines ""q""",1\n', encoding="utf-8")
    assert scans.csv(spark, str(tmp_path / "a.csv")).collect() == [("two\nlines \"q\"", "1")]
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert scans.json_array(spark, str(tmp_path / "a.json")).count() == 2
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 3}\n')
    assert scans.jsonl(spark, str(tmp_path / "a.jsonl.gz"), "a int").agg(F.sum("a")).first()[0] == 4


def test_archives(spark, tmp_path):
    data = b'{"utt": "hi"}\n{"utt": "ho"}\n'
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        for name in ("en.jsonl", "de.jsonl"):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    members = scans.archive(spark, str(tmp_path / "x.tar.gz"), pattern="^en")
    assert [r["utt"] for r in scans.member_lines(members, "utt string").collect()] == ["hi", "ho"]
    some = scans.archive(spark, str(tmp_path / "x.tar.gz"), keys=["de.jsonl", "fr.jsonl"])
    keys = spark.createDataFrame([("de.jsonl",), ("fr.jsonl",)], "name string")
    assert [r["member"] for r in some.collect()] == ["de.jsonl"] and [r["name"] for r in scans.missing_members(some, keys, "name").collect()] == ["fr.jsonl"]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil", b"x")
    with pytest.raises(Exception, match="unsafe member"):
        scans.archive(spark, str(tmp_path / "bad.zip")).collect()


def test_paged_source(spark, tmp_path):
    for at in (0, 2, 4):
        (tmp_path / f"p{at}.json").write_text(json.dumps({"rows": [{"row_idx": i, "row": {"v": i}} for i in range(at, min(at + 2, 5))]}))
    spark.dataSource.register(scans.PagedSource)
    (tmp_path / "p0.json").write_text(json.dumps({"rows": [{"row_idx": i, "row": {"v": i}} for i in (0, 1, 1)]}))  # a row comes twice
    options = {"location": str(tmp_path) + "/p{offset}.json", "length": "2", "retries": "0"}
    assert spark.read.format("paged").options(**options, total="5").load().count() == 5
    with pytest.raises(Exception, match="not contiguous"):
        spark.read.format("paged").options(**options, total="6").load().collect()


def test_zip_members_by_range(spark, tmp_path):
    import http.server
    import re
    import threading

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(20):
            z.writestr(f"m{i}.txt", b"%d" % i * 5000)
        z.writestr("packed.txt", b"ab" * 4000, zipfile.ZIP_DEFLATED)
        z.mkdir("folder")
    data = (tmp_path / "a.zip").read_bytes()
    spark.dataSource.register(scans.ZipSource)
    assert spark.read.format("zip_members").options(location=str(tmp_path / "a.zip"), partitions="3").load().where("length(content) >= 5000").count() == 21

    asked = []

    class Ranges(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()

        def do_GET(self):
            a, b = map(int, re.findall(r"\d+", self.headers["Range"]))
            asked.append((a, b))
            self.send_response(206)
            self.end_headers()
            self.wfile.write(data[a : b + 1][: 10 if self.path.startswith("/short") else None])

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        address = f"http://127.0.0.1:{server.server_port}"
        got = {r["member"]: bytes(r["content"]) for r in spark.read.format("zip_members").options(location=address + "/a.zip", partitions="3").load().collect()}
        assert got == {f"m{i}.txt": b"%d" % i * 5000 for i in range(20)} | {"packed.txt": b"ab" * 4000}
        assert sum(b - a < len(data) // 10 for a, b in asked) >= 20  # a member by a request of its own
        with pytest.raises(OSError, match="of"):
            scans._directory(address + "/short.zip")
    finally:
        server.shutdown()


def test_markup(spark):
    df = spark.createDataFrame([(1, '<a href="/x">The <b>link</b></a><input placeholder="Name"><button aria-label="Go">x</button>')], "id int, html string")
    assert [(r["tag"], r["name"]) for r in scans.html_controls(df, "id", "html").orderBy("place").collect()] == [("a", "The link"), ("input", "Name"), ("button", "Go")]
    tree = spark.createDataFrame([(1, "[1] root 'Main'\n  [2] button 'OK'\nnoise")], "id int, t string")
    assert [(r["depth"], r["role"], r["name"]) for r in scans.tree_nodes(tree, "id", "t").collect()] == [(0, "root", "Main"), (2, "button", "OK")]
    box = spark.createDataFrame([('{"aria_label": " ", "placeholder": "P", "bounding_box_rect": "1, 2,3,4"}', "")], "a string, t string").select(scans.candidate(F.col("a"), F.col("t")).alias("c")).first()["c"]
    assert box["name"] == "P" and box["box"] == [1, 2, 3, 4]


def test_coverage_and_lock(spark):
    a, b = spark.createDataFrame([(1, "f")], "id int, f string"), spark.createDataFrame([(1, "r"), (2, "r")], "id int, r string")
    with pytest.raises(Exception, match="differ"):
        scans.covered(a, b, "id").collect()
    pins, heads = spark.createDataFrame([("x", "1"), ("y", "2")], "repo string, revision string"), spark.createDataFrame([("x", "1"), ("y", "3")], "repo string, revision string")
    assert [r["repo"] for r in scans.locked(pins, heads).collect()] == ["y"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "train" if i % 3 else "dev") for i in range(200)], "id int, split string")
    sinks.write_splits(df, str(tmp_path / "s"), order=["id"])
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and sorted(sinks.split_digests(back, ["split"], ["id"]).collect()) == sorted(sinks.split_digests(df, ["split"], ["id"]).collect())
    assert sinks.append_missing(df.where("id < 100"), str(tmp_path / "p"), "id") == 100
    assert sinks.append_missing(df, str(tmp_path / "p"), "id") == 100 and sinks.append_missing(df, str(tmp_path / "p"), "id") == 0
    sinks.write_once(df, str(tmp_path / "o"))
    sinks.write_once(df, str(tmp_path / "o"))
    with pytest.raises(ValueError, match="another result"):
        sinks.write_once(df.where("id > 3"), str(tmp_path / "o"))
    sinks.overwrite_partitions(df.where("split = 'dev' AND id < 10"), str(tmp_path / "s"), "split")
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'train'").count() == 133
    sinks.finalize_parts(spark, [str(tmp_path / "p")], df, "id", str(tmp_path / "f"))
    with pytest.raises(ValueError, match="do not fit"):
        sinks.finalize_parts(spark, [str(tmp_path / "p"), str(tmp_path / "p")], df, "id", str(tmp_path / "g"))
    assert "| id |" in sinks.metrics_markdown(df.select("id").limit(2))


def test_waiting_for_output(spark, tmp_path):
    out = str(tmp_path / "w")
    assert not incremental.written(spark, out)
    with pytest.raises(TimeoutError):
        incremental.wait_for(lambda: incremental.written(spark, out), 0.05, 0.02)
    spark.range(3).write.parquet(out)
    assert incremental.wait_for(lambda: incremental.written(spark, out), 5) < 5


def test_incremental_stream_resumes_and_dedupes(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "id int, v string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(src + "/1")
    first = incremental.append_available(incremental.read_new(spark, src + "/*", schema), out, state, "id")
    spark.createDataFrame([(2, "b"), (3, "c")], schema).write.parquet(src + "/2")
    incremental.append_available(incremental.read_new(spark, src + "/*", schema), out, state, "id")
    incremental.append_available(incremental.read_new(spark, src + "/*", schema), out, state, "id")
    assert first == 2 and sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_release_and_locks(spark, tmp_path):
    df = spark.createDataFrame([(i, "train" if i % 3 else "dev", f"t{i}") for i in range(60)], "id int, split string, b string").withColumn("a", F.lit(None).cast("string"))
    sinks.write_sorted_jsonl(df, str(tmp_path / "j"), order=["id"])
    lines = [line for p in sorted((tmp_path / "j" / "split=train").glob("part-*")) for line in p.read_text().splitlines()]
    assert [json.loads(x)["id"] for x in lines] == [i for i in range(60) if i % 3] and lines[0] == '{"a":null,"b":"t1","id":1}'
    catalog = spark.createDataFrame([("r2", "v1"), ("r1", "v9")], "repo string, revision string")
    lock = sinks.write_lock(catalog, str(tmp_path / "lock"))
    assert lock == sinks.lock_digest(spark, str(tmp_path / "lock"))
    assert sinks.append_missing(df, str(tmp_path / "p"), "id", lock=lock) == 60 and sinks.append_missing(df, str(tmp_path / "p"), "id", lock=lock) == 0
    with pytest.raises(ValueError, match="another result"):
        sinks.append_missing(df, str(tmp_path / "p"), "id", lock="other")
    before = sinks.packaged(spark, str(tmp_path / "j")).select("file", "sha256").collect()
    said = spark.createDataFrame(before, "file string, sha256 string")
    assert sinks.readback(spark, str(tmp_path / "j"), said).count() == 0
    for p in (tmp_path / "j" / "split=dev").glob("part-*"):
        p.write_text("changed")
        p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
    assert {r["file"].split("/")[0][:5] for r in sinks.readback(spark, str(tmp_path / "j"), said).collect()} == {"split"}
    sinks.write_splits(df.select("id", "split", "b"), str(tmp_path / "k"), order=["id"])
    changed = spark.createDataFrame([(3, "new"), (999, "no")], "id int, b string")
    assert sinks.rewrite_keys(spark, str(tmp_path / "k"), "split", changed, "id", "b") == 1
    back = {r["id"]: r["b"] for r in spark.read.parquet(str(tmp_path / "k")).collect()}
    assert len(back) == 60 and back[3] == "new" and back[4] == "t4"


def test_lines_and_builders(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": "é"}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnope\n')
    spark.dataSource.register(scans.LineSource)
    read = lambda *paths: spark.read.format("http_lines").options(locations="\n".join(map(str, paths))).load()
    assert sorted((r["line_no"], json.loads(r["line"])["a"]) for r in read(tmp_path / "a.jsonl").collect()) == [(0, 1), (2, "é")]
    with pytest.raises(Exception, match="Expecting value"):
        read(tmp_path / "bad.jsonl").collect()
    made = []

    @scans.builder("tens")
    def tens(session, sf_dir):
        made.append(sf_dir)
        return session.range(10)

    assert [scans.built(spark, "tens", "sf", str(tmp_path / "cache")).count() for _ in range(2)] == [10, 10] and made == ["sf"]
    assert {(r["column"], r["n"], r["nulls"]) for r in scans.probe(spark.sql("SELECT explode(array(1, NULL)) AS a, 'x' AS `b.c`")).collect()} == {("a", 2, 1), ("b.c", 2, 0)}
