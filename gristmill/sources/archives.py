"""Tar archives of any size, read member by member in many tasks.

The headers of an archive are read once, by one task for each archive, into an index: a table of members with the bytes
that hold them. From then on an archive is a file with known spans: any number of tasks reads them by ranges, whatever
the archive's size, and keys are looked up in the index without a byte of content. A gzip stream can only be read from
its start, so its one pass also leaves access points: frames of the unpacked archive, each packed on its own, in a
folder that all executors see.

Locations are paths on a mount that driver and executors share, or http(s) addresses that answer ranges.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import re
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scans import _length, _span, unsafe

#: Bytes of the unpacked archive in a frame; bytes that a header scan reads ahead; bytes of content in one row.
FRAME, AHEAD, PART = 8 << 20, 1 << 16, 64 << 20
#: Bytes of small members that are handed on together.
HELD = 1 << 20
#: Bytes that one task should read.
STRETCH = 256 << 20
_ENTRY = "location string, member string, first long, size long, frames string, frame long"


def local(path: str) -> str:
    """A ``file:`` address as the path that Python opens; other schemes cannot be opened by tasks."""
    found = re.match(r"file:(?://)?(/.*)", path)
    if not found and re.match(r"[a-z][a-z0-9+.-]+:", path) and not path.startswith(("http://", "https://")):
        raise ValueError(f"{path!r} is no path on a shared mount and no http(s) address")
    return found[1] if found else path


class _Ranged(io.RawIOBase):
    """A file read by ranges, a little ahead, so that a header costs one request and content that is passed over none."""

    def __init__(self, location: str):
        self.location, self.size, self.at, self.begin, self.held = location, _length(location), 0, 0, b""

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = min(self.size - self.at if n < 0 else n, self.size - self.at)
        if n <= 0:
            return b""
        if not self.begin <= self.at or self.at + n > self.begin + len(self.held):
            self.begin, self.held = self.at, _span(self.location, self.at, min(max(n, AHEAD), self.size - self.at))
        out = self.held[self.at - self.begin : self.at - self.begin + n]
        self.at += n
        return out


class _Framed(io.RawIOBase):
    """Passes a stream on and stores what it passed as frames, each complete under its name or absent."""

    def __init__(self, stream, folder: str, size: int):
        self.stream, self.folder, self.size, self.held, self.frame = stream, folder, size, bytearray(), 0
        os.makedirs(folder, exist_ok=True)

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        out = self.stream.read(n)
        self.held += out
        while len(self.held) >= self.size:
            self._store()
        return out

    def _store(self) -> None:
        where = f"{self.folder}/{self.frame:010d}"
        some = f"{where}.{uuid.uuid4().hex}"
        with open(some, "wb") as f:
            f.write(zlib.compress(bytes(self.held[: self.size]), 1))
        os.replace(some, where)  # a second attempt writes the same bytes
        del self.held[: self.size]
        self.frame += 1

    def finish(self) -> None:
        while self.read(1 << 20):
            pass
        if self.held:
            self._store()


def _opened(location: str):
    if location.startswith(("http://", "https://")):
        from urllib.request import urlopen

        return urlopen(location, timeout=60)
    return open(location, "rb")


def _members(location: str, folder: str, frame: int) -> Iterator[tuple[str, str, int, int, str | None, int | None]]:
    """Index rows of one archive, in its order; headers only of a plain one, one pass over a packed one."""
    with _opened(location) as f:
        packed = f.read(2) == b"\x1f\x8b"
    frames = f"{folder}/{hashlib.sha256(location.encode()).hexdigest()[:24]}" if packed else None
    if packed:
        raw = _opened(location)
        stream = _Framed(gzip.GzipFile(fileobj=raw, mode="rb"), frames, frame)
        archive = tarfile.open(fileobj=stream, mode="r|")
    else:
        archive = tarfile.open(fileobj=_Ranged(location), mode="r:")
    with archive:
        for m in archive:
            archive.members = []  # else tarfile keeps every header
            if unsafe(m.name):
                raise ValueError(f"unsafe member {m.name!r} in {location}")
            if m.issparse():
                raise ValueError(f"sparse member {m.name!r} in {location}")
            if m.isfile():
                yield location, m.name, m.offset_data, m.size, frames, frame if packed else None
        if packed:
            stream.finish()
            raw.close()


def index(spark: SparkSession, locations: list[str], folder: str, frame: int = FRAME) -> DataFrame:
    """``location, member, first, size, frames, frame`` of all regular files in tar and tar.gz archives, stored under ``folder``.

    Made once: a second call with the same locations, lengths and folder reads what is stored, also after a run that
    was cut off. A task holds one header, or one frame, at a time. Unsafe and sparse members fail the job; links and
    folders are no members. A name that an archive holds twice is two members.
    """
    where = [local(x) for x in locations]
    state = hashlib.sha256("\n".join(f"{x} {_length(x)} {frame}" for x in where).encode()).hexdigest()[:24]
    table, store = f"{folder.rstrip('/')}/index-{state}", local(f"{folder.rstrip('/')}/frames-{state}")
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = [c.split()[0] for c in _ENTRY.split(", ")]
            for batch in frames:
                for location in batch["location"]:
                    some = []
                    for row in _members(location, store, frame):
                        some.append(row)
                        if len(some) == 4096:
                            yield pd.DataFrame(some, columns=names).astype({"frame": "Int64"})
                            some = []
                    if some:
                        yield pd.DataFrame(some, columns=names).astype({"frame": "Int64"})

        paths = spark.createDataFrame([(i, x) for i, x in enumerate(where)], "i int, location string")
        paths.repartitionById(len(where), F.col("i")).select("location").mapInPandas(run, _ENTRY).write.mode("overwrite").parquet(table)
    return spark.read.schema(_ENTRY).parquet(table)


def _content(location: str, frames: str | None, frame: int, first: int, size: int, cache: dict[str, bytes]) -> bytes:
    """Bytes of a span of the unpacked archive; ``cache`` keeps the last frame, as neighbours share it."""
    if frames is None:
        return _span(location, first, size) if size else b""
    out, at = [], first
    while at < first + size:
        where = f"{frames}/{at // frame:010d}"
        if where not in cache:
            with open(where, "rb") as f:
                data = zlib.decompress(f.read())
            cache.clear()
            cache[where] = data
        begin = at % frame
        out.append(cache[where][begin : begin + first + size - at])
        if not out[-1]:
            raise OSError(f"{where} ends before byte {begin}")
        at += len(out[-1])
    return b"".join(out)


def members(entries: DataFrame, part: int = PART, stretch: int = STRETCH) -> DataFrame:
    """``location, member, part, content`` of the index rows ``entries``: filter these, and only their bytes are read.

    Spans are dealt over tasks by stretches of the archive, so an archive is read by as many tasks as it has stretches,
    each nearly from start to end. A member beyond ``part`` bytes comes in parts, numbered from 0, so no cell is large.
    An empty member is one part without bytes; a span that cannot be read in full fails its task.
    """
    last = F.greatest(F.ceil(F.col("size") / part) - 1, F.lit(0)).cast("int")
    begin = F.col("part") * F.lit(part).cast("long")
    spans = entries.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    spans = spans.select("location", "frames", "frame", "member", "part", (F.col("first") + begin).alias("first"), F.least(F.lit(part).cast("long"), F.col("size") - begin).alias("size"))
    spans = spans.withColumn("stretch", F.floor(F.col("first") / stretch))
    # The number of tasks is that of stretches; left to itself, Spark would go by the size of the spans' few numbers.
    dealt = spans.repartition(max(1, spans.select("location", "stretch").distinct().count()), "location", "stretch").sortWithinPartitions("location", "first")

    kinds = pa.schema([("location", pa.string()), ("member", pa.string()), ("part", pa.int32()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, bytes] = {}
        some, held = [], 0
        for batch in batches:
            for location, store, unit, member, number, first, size in zip(*(c.to_pylist() for c in batch.columns)):
                data = _content(location, store, unit, first, size, cache)
                some.append({"location": location, "member": member, "part": number, "content": data})
                held += len(data)
                if held >= HELD or len(some) == 1024:
                    yield pa.RecordBatch.from_pylist(some, kinds)
                    some, held = [], 0
        if some:
            yield pa.RecordBatch.from_pylist(some, kinds)

    return dealt.select("location", "frames", F.coalesce("frame", F.lit(0)), "member", "part", "first", "size").mapInArrow(run, "location string, member string, part int, content binary")


def wanted(entries: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Index rows of the members that ``keys`` names, and the keys that no archive holds; no content is read for either."""
    names = keys.select(F.col(key).alias("member")).where("member IS NOT NULL").distinct()
    found = entries.join(names, "member", "left_semi").select(entries.columns)
    return found, names.join(entries.select("member").distinct(), "member", "left_anti").withColumnRenamed("member", key)


def write(df: DataFrame, folder: str, member: str, content: str, packed: bool = False) -> list[str]:
    """Writes each partition of ``df`` as one tar file under ``folder``; the paths of those with rows, in order.

    A task writes under a name of its own and renames at its end, so a retried or doubled task leaves one whole file.
    Null contents are empty members, rows without a name are an error. Contents are read
    where they lie in their batch, none is copied whole.
    """
    where = local(folder.rstrip("/"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = f"{where}/part-{TaskContext.get().partitionId():05d}.tar{'.gz' if packed else ''}"
        some, archive = f"{out}.{uuid.uuid4().hex}", None
        for batch in batches:
            for name, data in zip(*batch.columns):
                name, data = name.as_py(), data.as_buffer()
                if archive is None:
                    os.makedirs(where, exist_ok=True)
                    archive = tarfile.open(some, "w:gz" if packed else "w", format=tarfile.PAX_FORMAT)
                archive.members = []
                info = tarfile.TarInfo(name)
                info.size = data.size if data is not None else 0
                archive.addfile(info, pa.BufferReader(data) if data is not None else io.BytesIO())
        if archive is not None:
            archive.close()
            os.replace(some, out)
            yield pa.RecordBatch.from_pylist([{"path": out}])

    rows = df.select(F.col(member).cast("string"), F.col(content).cast("binary"))
    return sorted(r["path"] for r in rows.mapInArrow(run, "path string").collect())
