"""Scans: driver tables, text formats, archives, paged rows, markup and feature packs."""

from __future__ import annotations

import hashlib
import http.client
import inspect
import io
import json
import os
import re
import tarfile
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: The driver's tables.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; a byte-order mark is dropped."""
    reader = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8")
    out = (reader.schema(schema) if schema else reader).csv(path)
    return out.toDF(*[c.lstrip("﻿") for c in out.columns])


def json_array(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One object a line, plain or gzip by the file's name; a malformed line fails the job."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def parquet_shards(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """All shards of a glob; fails where their number is not the expected one."""
    out = spark.read.parquet(path)
    if expected is not None and (found := len(out.inputFiles())) != expected:
        raise ValueError(f"{found} shards instead of {expected}")
    return out


def _members(content: bytes, kind: str) -> Iterator[tuple[str, Callable[[], bytes]]]:
    """Names of an archive's files in order, each with a function that unpacks it."""
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            yield from ((i.filename, lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir())
    else:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as t:  # one pass, nothing kept of what was passed
            yield from ((m.name, lambda m=m: t.extractfile(m).read()) for m in t if m.isfile())


def unsafe(name: str) -> bool:
    """Whether a member would leave the folder that it is extracted to."""
    p = PurePosixPath(name)
    return p.is_absolute() or ".." in p.parts or "\\" in name or bool(re.match(r"[A-Za-z]:", name))


def archive(spark: SparkSession, path: str, pattern: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """``path, member, content`` of tar, tar.gz and zip files, one task per archive, members streamed.

    ``pattern`` keeps members by a regular expression, ``keys`` by name; only those are unpacked, and the pass over a
    tar file ends with the last key. An unsafe name fails the job. An archive is one binary value, so it must be under
    2 GB; larger zip files are read by ``ZipSource``.
    """
    wanted = re.compile(pattern) if pattern else None
    names = frozenset(keys) if keys is not None else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"]):
                pending = None if names is None else set(names)
                for name, unpack in _members(content, "zip" if p.endswith(".zip") else "tar"):
                    if unsafe(name):
                        raise ValueError(f"unsafe member {name!r} in {p}")
                    if (wanted is None or wanted.search(name)) and (pending is None or name in pending):
                        yield pd.DataFrame({"path": [p], "member": [name], "content": [unpack()]})
                        if pending is not None:
                            pending.discard(name)
                            if not pending:
                                break

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, content binary")


def missing_members(members: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keys that no archive held."""
    return keys.select(key).distinct().join(members.select(F.col("member").alias(key)).distinct(), key, "left_anti")


def member_lines(members: DataFrame, schema: str) -> DataFrame:
    """JSON lines of archive members as columns."""
    lines = members.select("path", "member", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where(F.trim("line") != "")
    return lines.select("path", "member", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("path", "member", "r.*")


class PagedSource(DataSource):
    """Rows of a paged endpoint, one partition a page: ``spark.dataSource.register(PagedSource)``, format ``paged``.

    Options: ``location`` (a format string with ``{offset}`` and ``{length}``, an http(s) address or a file),
    ``total``, ``length``, ``retries``. A page is JSON ``{"rows": [{"row_idx": n, "row": {...}}]}``. A row that a
    page repeats counts once. Pages must be contiguous: a page that lacks a row fails its task, and Spark's task
    retry asks again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "row_idx long, row string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.location, self.total = options["location"], int(options["total"])
        self.length, self.retries = int(options.get("length", "100")), int(options.get("retries", "3"))

    def partitions(self):
        return [InputPartition(at) for at in range(0, self.total, self.length)]

    def read(self, partition):
        from urllib.error import HTTPError
        from urllib.request import urlopen

        at = partition.value
        where = self.location.format(offset=at, length=self.length)
        for attempt in range(self.retries + 1):
            try:
                if where.startswith(("http://", "https://")):
                    with urlopen(where, timeout=60) as f:
                        page = json.load(f)
                else:
                    with open(where) as f:
                        page = json.load(f)
                break
            except HTTPError as e:
                if attempt == self.retries or e.code not in (429, 500, 502, 503, 504):
                    raise
                time.sleep((15 if e.code == 429 else 1) * 2**attempt)
        rows = {r["row_idx"]: r["row"] for r in reversed(page["rows"])}
        want = range(at, min(at + self.length, self.total))
        if rows.keys() != set(want):
            raise ValueError(f"page at {at} is not contiguous")
        for i in want:
            yield i, json.dumps(rows[i], ensure_ascii=False)


class LineSource(DataSource):
    """JSON lines of addresses or paths: format ``http_lines``, as a table or a stream.

    Options: ``locations`` (one a line), ``retries`` (in a row without a byte, 3), ``pause`` (seconds before the first retry,
    doubled each time; 1, and 15 where the server says 429). Lines are passed on as they arrive, so a file of any size
    needs the memory of one line. A connection that is cut goes on at the byte that it had reached, by a ranged request,
    so no line is lost or doubled. A blank line is passed over, a malformed one fails the task.

    As a stream, an offset is the number of bytes of whole lines of each location; a batch reads the spans that are new.
    ``line_no`` counts from the start of a span, and ``at`` is the line's first byte.
    """

    @classmethod
    def name(cls) -> str:
        return "http_lines"

    def schema(self) -> str:
        return "location string, line_no long, line string, at long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LineReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _LineStream(self.options)


def _bytes_from(location: str, first: int, end: int | None) -> Iterator[bytes]:
    """Bytes of a location from ``first`` to before ``end``; an error where the answer ends early."""
    if not location.startswith(("http://", "https://")):
        with open(location, "rb") as f:
            f.seek(first)
            left = end - first if end is not None else None
            while left != 0 and (some := f.read(1 << 16 if left is None else min(left, 1 << 16))):
                left = None if left is None else left - len(some)
                yield some
        return
    from urllib.request import Request, urlopen

    span = f"bytes={first}-{'' if end is None else end - 1}"
    with urlopen(Request(location, headers={"Range": span} if first or end is not None else {}), timeout=60) as f:
        size, got = int(f.headers["Content-Length"]), 0
        if first and f.status != 206:
            raise ValueError(f"{location} does not answer ranges")
        while some := f.read(1 << 16):
            got += len(some)
            yield some
        if got != size:
            raise OSError(f"{location} was cut after {got} of {size} bytes")


def _lines_from(location: str, first: int, end: int | None, retries: int, pause: float) -> Iterator[tuple[int, bytes]]:
    """First byte and content of each line of a span, over as many connections as it takes."""
    from urllib.error import HTTPError

    held, at, failed = b"", first, 0
    while True:
        try:
            for some in _bytes_from(location, at + len(held), end):
                failed = 0
                held += some
                *whole, held = held.split(b"\n")
                for line in whole:
                    yield at, line
                    at += len(line) + 1
            break
        except (OSError, http.client.HTTPException) as e:  # an HTTPError is an OSError
            code = e.code if isinstance(e, HTTPError) else None
            if code == 416 and first < at:  # nothing is left after the last byte
                break
            failed += 1
            if failed > retries or code is not None and code not in (429, 500, 502, 503, 504):
                raise
            time.sleep(pause * (15 if code == 429 else 1) * 2 ** (failed - 1))
    if held:
        yield at, held


class _LineReader(DataSourceReader):
    def __init__(self, options):
        self.locations = [x for x in options["locations"].split("\n") if x]
        self.retries, self.pause = int(options.get("retries", "3")), float(options.get("pause", "1"))

    def partitions(self):
        return [InputPartition((x, 0, None)) for x in self.locations]

    def read(self, partition):
        where, first, end = partition.value
        for i, (at, raw) in enumerate(_lines_from(where, first, end, self.retries, self.pause)):
            line = raw.decode("utf-8").strip()
            if line:
                json.loads(line)
                yield where, i, line, at


class _LineStream(DataSourceStreamReader):
    def __init__(self, options):
        self.lines = _LineReader(options)

    def initialOffset(self):
        return {x: 0 for x in self.lines.locations}

    def latestOffset(self):
        return {x: _whole_lines(x) for x in self.lines.locations}

    def partitions(self, start, end):
        return [InputPartition((x, start.get(x, 0), end[x])) for x in self.lines.locations if end[x] > start.get(x, 0)]

    def read(self, partition):
        return self.lines.read(partition)


def _whole_lines(location: str) -> int:
    """Bytes of a location up to the end of its last whole line, found from its end."""
    size, back = _length(location), 1 << 16
    while size:
        first = max(0, size - back)
        cut = _span(location, first, size - first).rfind(b"\n")
        if cut >= 0:
            return first + cut + 1
        if not first:
            break
        back *= 8
    return 0


def _span(location: str, first: int, size: int) -> bytes:
    """``size`` bytes of a file, or of what an address serves: one request, which must be answered in full."""
    if not location.startswith(("http://", "https://")):
        with open(location, "rb") as f:
            f.seek(first)
            data = f.read(size)
        if len(data) != size:
            raise OSError(f"{location} has {len(data)} of {size} bytes at {first}")
        return data
    from urllib.request import Request, urlopen

    with urlopen(Request(location, headers={"Range": f"bytes={first}-{first + size - 1}"}), timeout=60) as f:
        data = f.read()
        if f.status != 206 or len(data) != size:
            raise OSError(f"{location} answered {f.status} with {len(data)} of {size} bytes")
    return data


def _length(location: str) -> int:
    if not location.startswith(("http://", "https://")):
        return os.path.getsize(location)
    from urllib.request import Request, urlopen

    with urlopen(Request(location, method="HEAD"), timeout=60) as f:
        return int(f.headers["Content-Length"])


def _directory(location: str) -> list[tuple[str, int, int, int, int, int]]:
    """``name, first byte, bytes up to the next member, packed size, method, checksum`` of a zip file's members.

    Reads the end of the file only: more of it until the directory lies in what was read.
    """
    size, tail = _length(location), 1 << 16
    while True:
        tail = min(tail, size)
        try:
            with zipfile.ZipFile(io.BytesIO(_span(location, size - tail, tail))) as z:
                members, start = z.infolist(), z.start_dir
            break
        except zipfile.BadZipFile:
            if tail == size:
                raise
            tail *= 8
    shift = size - tail  # offsets were taken as if the file began where the tail does
    members.sort(key=lambda i: i.header_offset)
    begins = [i.header_offset + shift for i in members] + [start + shift]
    return [(i.filename, a, b - a, i.compress_size, i.compress_type, i.CRC) for i, a, b in zip(members, begins, begins[1:]) if not i.is_dir()]


def _unpacked(data: bytes, name: str, packed: int, method: int, checksum: int) -> bytes:
    """A member's bytes from its header on: the header's own lengths say where the packed bytes begin."""
    begin = 30 + int.from_bytes(data[26:28], "little") + int.from_bytes(data[28:30], "little")
    body = data[begin : begin + packed]
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"member {name!r} is packed by method {method}")
    out = body if method == zipfile.ZIP_STORED else zlib.decompress(body, -15)
    if zlib.crc32(out) != checksum:
        raise ValueError(f"member {name!r} does not fit its checksum")
    return out


class ZipSource(DataSource):
    """Members of one large zip file, dealt over partitions by bytes: format ``zip_members``.

    Options: ``location`` (http(s) address or path), ``partitions``. The driver reads the directory at the end of
    the file once; a task gets the byte spans of its own members and fetches each by one ranged request.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "member string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ZipReader(self.options)


class _ZipReader(DataSourceReader):
    def __init__(self, options):
        self.location, self.n = options["location"], int(options.get("partitions", "8"))

    def partitions(self):
        members = _directory(self.location)
        for name, *_ in members:
            if unsafe(name):
                raise ValueError(f"unsafe member {name!r}")
        total = sum(m[2] for m in members) or 1
        parts, load = [[] for _ in range(self.n)], 0
        for m in members:  # by the place of its middle, so each task gets a stretch of the file
            parts[min(self.n - 1, (load + m[2] // 2) * self.n // total)].append(m)
            load += m[2]
        return [InputPartition(p) for p in parts if p]

    def read(self, partition):
        for name, first, size, packed, method, checksum in partition.value:
            yield name, _unpacked(_span(self.location, first, size), name, packed, method, checksum)


class _Controls(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "button", "h1", "h2", "h3", "input", "select", "textarea"):
            a = dict(attrs)
            item = {"tag": tag, "name": a.get("aria-label") or a.get("placeholder") or a.get("title") or a.get("alt") or "", "href": a.get("href") or "", "text": []}
            self.out.append(item)
            if tag not in ("input",):
                self.open.append(item)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        for item in self.open:
            item["text"].append(data)


def html_controls(df: DataFrame, row: str, html: str) -> DataFrame:
    """``row, place, tag, name, href`` of links, buttons, headings and fields; name by label, then by text."""

    @F.pandas_udf("array<struct<tag:string,name:string,href:string>>")
    def parse(pages: pd.Series) -> pd.Series:
        def one(page):
            p = _Controls()
            p.feed(page or "")
            p.close()
            return [{"tag": i["tag"], "name": i["name"].strip() or " ".join("".join(i["text"]).split()), "href": i["href"]} for i in p.out]

        return pd.Series([one(x) for x in pages])

    return df.select(row, F.posexplode(parse(F.col(html))).alias("place", "c")).select(row, "place", "c.*")


def tree_nodes(df: DataFrame, row: str, text: str, pattern: str = r"^(\s*)\[(\w+)\]\s*(\w+)\s*'?(.*?)'?\s*$") -> DataFrame:
    """Nodes of an indented accessibility tree, one a line: depth, id, role and name; other lines are dropped."""
    lines = df.select(row, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).where(F.col("line").rlike(pattern))
    part = lambda i: F.regexp_extract("line", pattern, i)
    return lines.select(row, "line_no", F.length(part(1)).alias("depth"), part(2).alias("node"), part(3).alias("role"), part(4).alias("name"))


def candidate(attributes: Column, text: Column) -> Column:
    """Name and box of a page element: first nonblank of label, text, placeholder, title and alt; box of positive size."""
    a = F.from_json(attributes, "role string, aria_label string, placeholder string, title string, alt string, bounding_box_rect string")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    name = F.coalesce(blank(a["aria_label"]), blank(text), blank(a["placeholder"]), blank(a["title"]), blank(a["alt"]))
    box = F.transform(F.split(a["bounding_box_rect"], ","), lambda x: F.trim(x).try_cast("double"))
    good = (F.size(box) == 4) & F.coalesce(F.element_at(box, 3) > 0, F.lit(False)) & F.coalesce(F.element_at(box, 4) > 0, F.lit(False))
    return F.struct(name.alias("name"), blank(a["role"]).alias("role"), F.when(good, box).alias("box"))


def covered(features: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Features joined one to one with rows; the job fails where either side has a key that the other lacks."""
    both = features.withColumn("_f", F.lit(1)).join(rows.withColumn("_r", F.lit(1)), key, "full_outer")
    ok = F.col("_f").isNotNull() & F.col("_r").isNotNull()
    return both.withColumn("_ok", F.assert_true(ok, "features and rows differ")).where("_ok IS NULL").drop("_ok", "_f", "_r")


def locked(catalog: DataFrame, heads: DataFrame) -> DataFrame:
    """Sources whose head is not the pinned revision, or that have no pin or head; empty if all agree."""
    both = catalog.select("repo", F.col("revision").alias("pinned")).join(heads.select("repo", F.col("revision").alias("head")), "repo", "full_outer")
    return both.where(~F.col("pinned").eqNullSafe(F.col("head")))


#: Builders by name, as a small registry.
BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def builder(name: str):
    """Registers a function that builds one source's rows."""

    def add(f):
        BUILDERS[name] = f
        return f

    return add


def input_lock(spark: SparkSession, *paths: str) -> str:
    """Digest of the files below some paths: their names, lengths and times, as the file system lists them."""
    found = []
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        files = fs.listFiles(root, True) if fs.exists(root) else None
        while files is not None and files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def stage_key(name: str, lock: str, params: dict) -> str:
    """What a stage's rows depend on: the builder's name and code, the lock of its inputs, and its parameters."""
    f = BUILDERS[name]
    try:
        code = inspect.getsource(f)
    except OSError:  # made at a prompt
        code = f.__code__.co_code.hex() + repr(f.__code__.co_consts)
    return hashlib.sha256(json.dumps([name, code, lock, params], sort_keys=True, default=str).encode()).hexdigest()[:32]


def built(spark: SparkSession, name: str, sf_dir: str, cache: str, lock: str | None = None, **params) -> DataFrame:
    """The rows of a registered builder, made once for each state of its inputs, parameters and code.

    They are stored under ``cache/name/key``. ``lock`` stands for the state of the inputs (see ``sinks.lock_digest``); by
    default it is that of the files below ``sf_dir``. If it changes, rows are made again; what is stored for another
    state is not read, and stays until ``sweep``. A run that was cut off is made again.
    """
    key = stage_key(name, input_lock(spark, sf_dir) if lock is None else lock, params)
    where = f"{cache.rstrip('/')}/{name}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        BUILDERS[name](spark, sf_dir, **params).write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def sweep(spark: SparkSession, cache: str, keep: set[tuple[str, str]]) -> list[tuple[str, str]]:
    """Removes all stages ``(name, key)`` below ``cache`` but those in ``keep``; what was removed. Run it while no job reads them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(cache)
    fs, gone = root.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for stage in fs.listStatus(root) if fs.exists(root) else []:
        for one in fs.listStatus(stage.getPath()):
            found = (stage.getPath().getName(), one.getPath().getName())
            if found not in keep and fs.delete(one.getPath(), True):
                gone.append(found)
    return sorted(gone)


def probe(df: DataFrame, rows: int = 3) -> DataFrame:
    """``column, type, n, nulls, first`` of a source: its schema, counts, and the first of a few rows as JSON, in one pass."""
    stats = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    head = df.limit(rows).agg(*[F.collect_list(F.to_json(F.struct(F.col(f"`{c}`").alias("v")))).alias(f"f{i}") for i, c in enumerate(df.columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("n"), (F.col("n") - F.col(f"c{i}")).alias("nulls"), F.get(F.col(f"f{i}"), F.lit(0)).alias("first")) for i, (c, t) in enumerate(df.dtypes)])
    return stats.crossJoin(F.broadcast(head)).select(F.explode(each).alias("e")).select("e.*")  # one row each
