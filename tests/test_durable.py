"""Stages by content, scopes that clean up, parts that are published together, lines over cut connections, prefixes."""

import glob
import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from gristmill import lineage
from gristmill.operators.neardup import prefix_join
from gristmill.sources import parts, scans


def test_stages_follow_their_inputs(spark, tmp_path):
    source, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    spark.range(5).write.parquet(source)
    made = []

    @scans.builder("rows")
    def rows(session, where, times=1):
        made.append(times)
        return session.read.parquet(where).select((F.col("id") * times).alias("id"))

    total = lambda **p: scans.built(spark, "rows", source, cache, **p).agg(F.sum("id")).first()[0]
    assert [total(), total(), total(times=2), total(times=2), total()] == [10, 10, 20, 20, 10] and made == [1, 2]
    spark.range(100, 101).write.mode("append").parquet(source)
    assert [total(), total()] == [110, 110] and made == [1, 2, 1]
    assert [total(lock="a"), total(lock="a"), total(lock="b")] == [110] * 3 and made == [1, 2, 1, 1, 1]
    now = ("rows", scans.stage_key("rows", scans.input_lock(spark, source), {}))
    assert len(scans.sweep(spark, cache, {now})) == 4 and scans.sweep(spark, cache, {now}) == []
    assert total() == 110 and made == [1, 2, 1, 1, 1]
    old = scans.stage_key("rows", "x", {})

    @scans.builder("rows")
    def changed(session, where, times=1):
        return session.range(3)

    assert scans.stage_key("rows", "x", {}) != old


def test_scopes_leave_the_shared_folder_as_it_was(spark):
    folder = lineage.shared_dir(spark)
    before = sorted(os.listdir(folder))
    with lineage.scope(spark):
        outer = lineage.stored(spark.range(3))
        with pytest.raises(ZeroDivisionError), lineage.scope(spark):
            lineage.stored(spark.range(4))
            raise ZeroDivisionError
        assert outer.count() == 3
    assert [x for x in sorted(os.listdir(folder)) if x.startswith("gristmill-")] == [x for x in before if x.startswith("gristmill-")]


def test_parts_are_published_together_or_not_at_all(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("s")).repartition(5)
    good = str(tmp_path / "good")
    parts.write_covered(df, f"file:{good}", ["id"], df)
    assert sorted(spark.read.parquet(good).collect()) == sorted(df.collect()) and len(glob.glob(f"{good}/part-*")) == 5
    assert os.listdir(tmp_path) == ["good"]
    for bad in (df.where("id <> 4"), df.unionByName(df.where("id = 4")), df.withColumn("id", F.when(F.col("id") == 4, 5).otherwise(F.col("id")))):
        with pytest.raises(Exception, match="do not cover"):
            parts.write_covered(bad, str(tmp_path / "bad"), ["id"], df)
        assert os.listdir(tmp_path) == ["good"]
    with pytest.raises(ValueError, match="exists"):
        parts.write_covered(df, good, ["id"], df)
    parts.write_covered(df.where("false"), str(tmp_path / "none"), ["id"], df.where("false"))
    assert os.listdir(tmp_path / "none") == ["_SUCCESS"]
    parts.write_covered(df, str(tmp_path / "two"), ["s", "id"], df)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    df = spark.range(100).repartition(3).select("id", F.when(F.col("id") == 50, F.raise_error(F.lit("broken row"))).otherwise(F.lit(1)).alias("v"))
    with pytest.raises(Exception, match="broken row"):
        parts.write_covered(df, str(tmp_path / "bad"), ["id"], spark.range(100))
    assert os.listdir(tmp_path) == []


def test_files_of_attempts_that_were_not_committed_are_removed(tmp_path):
    writer = parts._PartWriter({"path": str(tmp_path / "out"), "rows": "0", "one": "0", "two": "0"})
    open(f"{writer.stage}/part-twice.parquet", "w").close()
    writer.commit([None, parts._Part("", 0, 0, 0)])
    assert os.listdir(tmp_path) == ["out"] and os.listdir(tmp_path / "out") == ["_SUCCESS"]


@pytest.fixture
def cut_server():
    """Serves bytes by range, but every second answer ends after 700 bytes of what it promises."""
    data, seen = {}, []

    class Cutting(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(data[self.path])))
            self.end_headers()

        def do_GET(self):
            body, status = data[self.path], 200
            if span := self.headers.get("Range"):
                a, b = span.removeprefix("bytes=").split("-")
                body, status = body[int(a) : int(b) + 1 if b else None], 206
            seen.append((self.path, span, len(body)))
            busy = self.path == "/busy" and len(seen) % 2
            self.send_response(429 if busy else status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body[: 700 if len(seen) % 2 == 0 else 333])

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Cutting)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", data, seen
    server.shutdown()


def test_a_cut_connection_goes_on_at_its_byte(spark, cut_server):
    base, data, seen = cut_server
    rows = [json.dumps({"i": i, "t": "é" * (i % 50)}, ensure_ascii=False) for i in range(120)]
    data["/a"] = ("\n".join(rows[:60]) + "\n\n" + "\n".join(rows[60:])).encode()
    spark.dataSource.register(scans.LineSource)
    read = lambda path, **o: spark.read.format("http_lines").options(locations=base + path, pause="0.01", **o).load().collect()
    got = read("/a", retries="1")
    assert [r["line"] for r in sorted(got, key=lambda r: r["line_no"])] == rows
    assert all(data["/a"][r["at"] :].startswith(r["line"].encode()) for r in got)
    # Nothing was asked for twice: each request begins where the one before ended.
    assert len(seen) > 5 and [int(s.removeprefix("bytes=")[:-1]) for _, s, _ in seen[1:]] == [sum(700 if (i + 1) % 2 == 0 else 333 for i in range(k)) for k in range(1, len(seen))]
    data["/busy"] = data["/a"]
    assert len(read("/busy", retries="2")) == 120
    with pytest.raises(Exception, match="429"):
        read("/busy", retries="0")


def test_lines_as_a_stream(spark, tmp_path):
    path = tmp_path / "grows.jsonl"
    path.write_text('{"a": 1}\n{"a": 2}\n{"a": ')  # the last line is not whole yet
    spark.dataSource.register(scans.LineSource)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = spark.readStream.format("http_lines").options(locations=str(path)).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", check).start(out)
        query.processAllAvailable()
        query.stop()
        return sorted(json.loads(r["line"])["a"] for r in spark.read.schema("line string").parquet(out).collect())

    assert run() == [1, 2]
    with open(path, "a") as f:
        f.write('3}\n{"a": 4}\n')
    assert run() == [1, 2, 3, 4] and run() == [1, 2, 3, 4]


def test_prefixes(spark):
    names = [f"https://same.host/{'x' * (i % 5)}{i % 9}é" for i in range(300)] + [None, "", "h", "https://same.host/" * 2] * 2
    prefixes = ["", "h", "https://same.host/", "https://same.host/x", "https://same.host/xx3", "https://same.host/xx3é and more", "é", None, "z"]
    got = prefix_join(spark.createDataFrame(list(enumerate(names)), "i int, name string"), "name", spark.createDataFrame([(p,) for p in prefixes], "prefix string"), "prefix")
    assert sorted((r["i"], r["prefix"]) for r in got.collect()) == sorted((i, p) for i, n in enumerate(names) for p in prefixes if n is not None and p is not None and n.startswith(p))
    assert prefix_join(spark.createDataFrame([], "name string"), "name", spark.createDataFrame([("a",)], "prefix string"), "prefix").count() == 0
