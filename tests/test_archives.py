"""Tar archives by index and ranges, against tarfile itself."""

import functools
import http.server
import io
import os
import tarfile
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.sources import archives


def packed(path, files, mode="w", extra=()):
    with tarfile.open(path, mode, format=tarfile.PAX_FORMAT) as t:
        for m in extra:
            t.addfile(m)
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return str(path)


def by_tarfile(paths):
    out = []
    for p in paths:
        with tarfile.open(p) as t:
            out += [(p, m.name, t.extractfile(m).read()) for m in t if m.isfile()]
    return sorted(out)


def joined(rows):
    """Parts of members put together again, per location, name and order of the archive."""
    whole = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        whole.setdefault((r["location"], r["member"]), []).append(bytes(r["content"]))
    return sorted((*k, b"".join(v)) for k, v in whole.items())


@pytest.fixture
def files():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 511, 512, 513, 5000, 70_000, 200_001]
    return [(f"de/{'x' * 150 if i % 3 == 0 else 'é'}/{i}.txt", rng.bytes(sizes[i % len(sizes)])) for i in range(40)]


@pytest.mark.parametrize("mode,ending", [("w", ".tar"), ("w:gz", ".tar.gz")])
def test_member_for_member(spark, tmp_path, files, mode, ending):
    folder = tarfile.TarInfo("de")
    folder.type = tarfile.DIRTYPE
    link = tarfile.TarInfo("link")
    link.type, link.linkname = tarfile.SYMTYPE, "de"
    paths = [packed(tmp_path / f"a{i}{ending}", files[i::3], mode, [folder, link]) for i in range(3)]
    entries = archives.index(spark, paths, str(tmp_path / "index"), 30_000)
    assert entries.count() == len(files)
    got = archives.members(entries, part=1 << 30, stretch=20_000)
    assert joined(got.collect()) == by_tarfile(paths)
    # An archive is read by several tasks, a large member in parts.
    tasks = archives.members(entries, part=50_000, stretch=20_000).withColumn("task", F.spark_partition_id()).collect()
    assert joined(tasks) == by_tarfile(paths)
    assert len({r["task"] for r in tasks if r["location"] == paths[0]}) > 1 and max(r["part"] for r in tasks) == 4
    assert max(len(r["content"]) for r in tasks) == 50_000


def test_index_is_made_once(spark, tmp_path, files):
    path = packed(tmp_path / "a.tar.gz", files, "w:gz")
    first = archives.index(spark, [path], str(tmp_path / "i")).collect()
    os.rename(path, f"{path}.gone")
    with open(path, "wb") as f:  # same length: neither the headers nor the packed bytes are looked at again
        f.truncate(os.path.getsize(f"{path}.gone"))
    again = archives.index(spark, [path], str(tmp_path / "i"))
    assert again.collect() == first
    assert [bytes(r["content"]) for r in archives.members(again.where("member like '%/5.txt'")).collect()] == [files[5][1]]


def test_keys_and_patterns(spark, tmp_path, files):
    path = packed(tmp_path / "a.tar", files)
    entries = archives.index(spark, [path], str(tmp_path / "i"))
    keys = spark.createDataFrame([(files[3][0],), (files[7][0],), ("nowhere",), (None,), (files[3][0],)], "k string")
    found, missing = archives.wanted(entries, keys, "k")
    assert {r["member"]: bytes(r["content"]) for r in archives.members(found).collect()} == dict([files[3], files[7]])
    assert [r["k"] for r in missing.collect()] == ["nowhere"]
    assert archives.members(entries.where(F.col("member").rlike("^de/é/"))).count() == sum(n.startswith("de/é/") for n, _ in files)


def test_only_headers_and_spans_are_requested(spark, tmp_path):
    """Over http: an index needs a small share of the bytes, one member its own."""
    served = []

    class Ranged(http.server.SimpleHTTPRequestHandler):
        def do_GET(self):
            with open(self.translate_path(self.path), "rb") as f:
                data = f.read()
            if span := self.headers.get("Range"):
                a, b = map(int, span.removeprefix("bytes=").split("-"))
                data = data[a : b + 1]
            served.append(len(data) if span else 0)
            self.send_response(206 if span else 200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            try:
                self.wfile.write(data)
            except OSError:
                pass  # the reader looked at the first bytes only

        def log_message(self, *args):
            pass

    rng = np.random.default_rng(1)
    files = [(f"m{i}", rng.bytes(1_000_000)) for i in range(8)]
    packed(tmp_path / "a.tar", files)
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Ranged, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        entries = archives.index(spark, [f"http://127.0.0.1:{server.server_port}/a.tar"], str(tmp_path / "i"))
        assert entries.count() == 8 and sum(served) < 1_000_000
        served.clear()
        assert [bytes(r["content"]) for r in archives.members(entries.where("member = 'm5'")).collect()] == [files[5][1]]
        assert sum(served) == 1_000_000
    finally:
        server.shutdown()


def test_unsafe_and_unreadable(spark, tmp_path):
    bad = packed(tmp_path / "bad.tar", [("../up", b"x")])
    with pytest.raises(Exception, match="unsafe member"):
        archives.index(spark, [bad], str(tmp_path / "i"))
    with pytest.raises(ValueError, match="shared mount"):
        archives.index(spark, ["hdfs://host/a.tar"], str(tmp_path / "i"))
    cut = packed(tmp_path / "cut.tar", [("a", b"x" * 100_000)])
    entries = archives.index(spark, [cut], str(tmp_path / "i2"))
    with open(cut, "r+b") as f:
        f.truncate(1000)
    with pytest.raises(Exception, match="of 100000 bytes"):
        archives.members(entries).collect()


def test_written_archives_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i}", None if i == 3 else bytes([i]) * i) for i in range(50)], "name string, data binary").repartition(4)
    for packed_ in (False, True):
        paths = archives.write(rows, f"file:{tmp_path}/out{packed_}", "name", "data", packed_)
        assert 1 < len(paths) <= 4 and not [f for p in paths for f in os.listdir(os.path.dirname(p)) if not f.endswith((".tar", ".gz"))]
        entries = archives.index(spark, paths, f"{tmp_path}/i{packed_}")
        assert {r["member"]: bytes(r["content"]) for r in archives.members(entries).collect()} == {f"n{i}": b"" if i == 3 else bytes([i]) * i for i in range(50)}
    assert archives.write(rows.where("false"), f"{tmp_path}/none", "name", "data") == []
