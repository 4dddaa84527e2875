"""Line dedup: range-partitioned line hashes, streamed in order; per-document keep bitmaps come back.

1. Each document gives one row for every distinct long line: a 128-bit hash of the line's key, the document
   and the line's positions. No text is shuffled.
2. Rows are range-partitioned by ``(hash, document, copy)`` with the document descending and sorted within the
   partition, so a hash that a third of all documents hold is spread over many partitions.
3. Each partition is streamed once. The first row of a run of one hash is the largest document that holds
   it; the rest are drops once the run is long enough. Only the first and the last run of a partition may go
   on elsewhere; their rows come out undecided, with one summary for each such run.
4. Summaries (two for each partition at most) are added up and decide the undecided rows, which meet them by a
   broadcast or, beyond ``BROADCAST_RUNS``, by a join that leaves rows of a hot hash where they are.
5. Drops of a document are gathered into a compressed bitmap of the lines that it keeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.skew import spread_join

from .common import fresh, shuffle_partitions, stable

MIN_CHARS, MIN_DOCS = 40, 5
#: Summaries are broadcast up to so many (about 100 bytes each).
BROADCAST_RUNS = 100_000
_BLANK = " \t\n\x0b\x0c\r"
_UPPER = {c: c + 32 for c in range(65, 91)}


def line_key(line: str) -> str:
    """The line stripped of ASCII blanks at both ends, with A-Z in lower case."""
    return line.strip(_BLANK).translate(_UPPER)


def _key_bytes(line: str) -> bytes:
    return line.strip(_BLANK).encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only


def _lines(min_chars: int):
    """Rows of a batch's long lines: one for each row of the table and distinct hash, with all its positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hashes, docs, marks, totals, places = [], [], [], [], []
                for doc, mark, text in zip(*(c.to_pylist() for c in part.columns)):
                    own: dict[bytes, list[int]] = {}
                    lines = (text or "").split("\n")
                    for i, line in enumerate(lines):
                        if len(line) >= min_chars and len(line.strip(_BLANK)) >= min_chars:
                            own.setdefault(digest(_key_bytes(line)), []).append(i)
                    hashes += own
                    docs += [doc] * len(own)
                    marks += [mark] * len(own)
                    totals += [len(lines)] * len(own)
                    places += [np.array(p, dtype="<u4").tobytes() for p in own.values()]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array(totals, pa.int32()), pa.array(places, pa.binary())], ["hash", "doc_id", "mark", "total", "places"])

    return run


_OUT = ["kind", "hash", "doc_id", "mark", "total", "places", "docs"]
_TYPES = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
_DROP, _OPEN, _SUMMARY = 0, 1, 2


def _stream(min_docs: int, chunk: int = 4096):
    """One pass over a sorted partition, holding a few thousand rows at most.

    Emits drops, undecided rows of runs that may go on in another partition, and a summary of each such run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        current = top = last = None
        docs, open_run, first = 0, True, True

        def close(final: bool) -> None:
            if open_run or final:
                out.extend((_OPEN, *r, None) for r in held)
                out.append((_SUMMARY, current, top, None, None, None, docs))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                h, doc = row[0], row[1]
                if first or h != current:
                    if not first:
                        close(False)
                    current, top, last, docs, open_run, first, held = h, doc, doc, 1, first, False, []
                elif doc != last:
                    last, docs = doc, docs + 1
                if open_run:
                    out.append((_OPEN, *row, None))
                elif doc != top:  # the run began here, so its first document is the largest of all
                    if docs >= min_docs:
                        out.extend((_DROP, *r, None) for r in held)
                        out.append((_DROP, *row, None))
                        held = []
                    else:
                        held.append(row)
                        if len(held) >= chunk:  # one document in very many versions: decided later
                            out.extend((_OPEN, *r, None) for r in held)
                            held, open_run = [], True
                if len(out) >= chunk:
                    yield _batch(out)
                    out.clear()
        if not first:
            close(True)
        yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _OUT]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _OUT)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, marks, totals, places = (c.to_pylist() for c in batch.columns)
        lost, maps = [], []
        for total, parts in zip(totals, places):
            keep = np.ones(total, dtype=bool)
            keep[np.frombuffer(b"".join(parts), dtype="<u4")] = False
            lost.append(int(total - keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array(totals, pa.int32()), pa.array(lost, pa.int32()), pa.array(maps, pa.binary())], ["doc_id", "mark", "n_lines", "n_dropped", "keep_bitmap"])


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    """Booleans of the lines kept, in order."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n_lines).astype(bool)


def text_mark(text):
    """64-bit mark that, with the id, tells rows apart where ids repeat."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """``doc_id, mark, n_lines, n_dropped, keep_bitmap`` of the documents that lose lines.

    A line's key is the line stripped of ASCII blanks with A-Z in lower case. Keys of at least ``min_chars``
    code points that at least ``min_docs`` different ids hold lose all their lines but those of the largest
    id. ``mark`` is ``text_mark`` of the row's text; ``keep_bitmap`` is zlib over packed bits, first line
    first (``unpack``).

    Defined cases: null or empty text is one empty line; rows that repeat an id count as one document and
    each is cut; null ids are one document, smaller than all others; texts of any length and number of lines count
    whole; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_mark(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    lines = stable(rows.mapInArrow(_lines(min_chars), "hash binary, doc_id long, mark long, total int, places binary"))
    order = [F.col("hash"), F.col("doc_id").desc()]
    ranged = lines.repartitionByRange(partitions or shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    seen = stable(ranged.mapInArrow(_stream(min_docs), "kind int, hash binary, doc_id long, mark long, total int, places binary, docs long"))
    runs = seen.where(F.col("kind") == _SUMMARY).groupBy("hash").agg(F.sum("docs").alias("docs"), F.max("doc_id").alias("top"))
    runs = runs.where(F.col("docs") >= min_docs).select("hash", "top")
    opened = seen.where(F.col("kind") == _OPEN).drop("docs")
    if seen.where(F.col("kind") == _SUMMARY).count() <= BROADCAST_RUNS:
        undecided = opened.join(F.broadcast(runs), "hash")
    else:
        counted = stable(opened.groupBy("hash").agg(F.count("*").alias("n")).join(runs, "hash"))
        undecided = spread_join(opened, counted, "hash", "n", counted.agg(F.sum("n")).first()[0] or 0)
    late = undecided.where(~F.col("doc_id").eqNullSafe(F.col("top")))
    columns = ["doc_id", "mark", "total", "places"]
    drops = seen.where(F.col("kind") == _DROP).select(*columns).unionByName(late.select(*columns))
    whole = drops.groupBy("doc_id", "mark").agg(F.max("total").alias("total"), F.collect_list("places").alias("places"))
    return whole.mapInArrow(_bitmaps, "doc_id long, mark long, n_lines int, n_dropped int, keep_bitmap binary")


def with_kept_text(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``text_col`` cut to the kept lines, and ``_n_lines``, ``_n_dropped``.

    Defined cases: a text that loses nothing comes back as it was (null stays null and has one line); of rows that
    repeat each is cut; columns that already have the two names are replaced, all others come back whatever their
    names; texts of any length are cut whole; an empty table stays empty.
    """
    mark, own, cut_mark, lost, bitmap = fresh(docs, "mark", "own", "cut", "lost", "bitmap")
    marked = docs.withColumn(mark, text_mark(F.col(text_col)))
    cuts = bitmaps.select(F.col("doc_id").alias(own), F.col("mark").alias(cut_mark), F.col("n_dropped").alias(lost), F.col("keep_bitmap").alias(bitmap))
    both = marked.join(cuts, F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(mark) == F.col(cut_mark)), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        def one(t, b):
            if b is None or t is None:
                return t
            lines = t.split("\n")
            keep = unpack(b, len(lines))
            return "\n".join(x for x, k in zip(lines, keep) if k)

        return pd.Series([one(t, b) for t, b in zip(text, bitmap)], dtype=object)

    n_lines = F.length(F.coalesce(F.col(text_col), F.lit(""))) - F.length(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n"), F.lit(""))) + 1
    return both.withColumns({"_n_lines": n_lines.cast("long"), "_n_dropped": F.coalesce(lost, F.lit(0)).cast("long"), text_col: cut(F.col(text_col), F.col(bitmap))}).drop(own, cut_mark, lost, bitmap, mark)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256``: one row per document, from its keep bitmap."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = with_kept_text(slim, keep_bitmaps(slim, min_chars, min_docs))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
