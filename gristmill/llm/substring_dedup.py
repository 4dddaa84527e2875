"""Substring dedup by sliding sentence spans.

A sentence ends at a word that ends in a full stop, an exclamation or a question mark. A sentence of more than
``WINDOW`` words is cut further, after the word of the least hash in each run of ``WINDOW`` words, so that a long
sentence is cut alike wherever a passage enters or leaves it. Any ``WINDOW`` words in a row hold a cut, and the cuts
of a passage depend on the passage alone but for ``WINDOW - 1`` words at either end. A *span* is the run of
consecutive sentences from each sentence on that has at least ``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words:
a passage of ``MIN_WORDS + 3 * (WINDOW - 1)`` = 51 words or more always holds a whole one. One more span goes from the
last of these starts to the end of the text, so that a whole copy of a text leaves none of its words.

All spans of all documents are hashed (96 bits) and range-partitioned by ``(hash, document, position)``; in that
order every row but the first of its hash is a repeat, so one streamed pass finds them, and a span that a third of
all documents hold is spread over many partitions. Only the first row of a partition depends on another: two rows
for each partition are settled on the driver. Sentences that a repeat covers are removed from their document; words
of a passage outside its inner cuts stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stable

MIN_SENTENCES, MIN_WORDS = 3, 30
#: A sentence of more words is cut after the least word hash of so many words in a row.
WINDOW = 8
_STOPS = [ord(c) for c in ".!?"]
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_WORD = re.compile(r"\S+")


#: Words that are hashed in one go; a longer text is a go of its own.
_GO = 60_000


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), np.uint64(base))], dtype=np.uint64)[:n]


_KEPT = tuple(_powers(2 * _GO, base) for base in (_MULT, _INVERSE))


def sentences(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, the first word of each sentence with the number of words as the last entry,
    and, for each text, how many sentences it and those before it have. The words are in lower case."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(size)
    n = int(ends[-1]) if len(ends) else 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(texts)), dtype=np.uint64, count=n)
    last = np.frombuffer("".join([w[-1] for t in texts for w in t]).encode("utf-32-le"), dtype="<u4")
    stop = np.isin(last, _STOPS)
    h = h >> np.uint64(1) << np.uint64(1) | stop  # the lowest bit says that the word ends a sentence
    stop[ends[size > 0] - 1] = True  # a text ends its last sentence
    if len(h) > WINDOW:
        length = np.diff(np.r_[0, np.flatnonzero(stop) + 1])
        long = np.repeat(length > WINDOW, length)
        first = np.arange(len(h) - WINDOW + 1)
        first = first[first + WINDOW <= np.repeat(ends, size)[: len(first)]]  # within one text
        first = first[long[first] | long[first + WINDOW - 1]]
        rows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        for at in range(0, len(first), 1 << 16):
            own = first[at : at + (1 << 16)]
            least = rows[own].argmin(axis=1) + own
            stop[least[long[least]]] = True
    at = np.r_[0, np.flatnonzero(stop) + 1]
    return h, at, np.searchsorted(at, ends)


def spans(texts: list[list[str]], min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, hash, more bits of it, first sentence, end sentence)`` of every span, by text, first and end sentence.

    A text's spans begin at its first sentences in turn; where the last of them ends before the text, one more from the same
    sentence on goes to the end.
    """
    h, at, upto = sentences(texts)
    many = np.diff(np.r_[0, upto])
    text, own = np.repeat(np.arange(len(texts)), many), np.arange(len(at) - 1)
    end = np.maximum(np.searchsorted(at, at[:-1] + min_words), own + min_sentences)
    keep = end <= upto[text]
    text, own, end = text[keep], own[keep], end[keep]
    last = np.flatnonzero(np.r_[text[1:] != text[:-1], True][: len(text)] & (end < upto[text]))
    text, own, end = np.insert(text, last + 1, text[last]), np.insert(own, last + 1, own[last]), np.insert(end, last + 1, upto[text[last]])
    powers, inverse = _KEPT if len(h) < 2 * _GO else (_powers(len(h) + 1, _MULT), _powers(len(h) + 1, _INVERSE))
    begin, size = at[own], (at[end] - at[own]).astype(np.uint64)

    def rolled(h: np.ndarray) -> np.ndarray:
        total = np.r_[np.uint64(0), np.cumsum(h * powers[: len(h)], dtype=np.uint64)]
        out = (total[at[end]] - total[begin]) * inverse[begin] + size
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))

    with np.errstate(over="ignore"):
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        more = (rolled(mixed ^ (mixed >> np.uint64(32))) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        before = (upto - many)[text]
        return text, rolled(h), more, own - before, end - before


def _rows(min_sentences: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            texts: list[list[str]] = []

            def found() -> pa.RecordBatch:
                text, h, more, _, _ = spans(texts, min_sentences, min_words)
                row = pa.array(np.array(rows, dtype=np.int64)[text])
                place = np.arange(len(text)) - np.searchsorted(text, text)  # of the span in its text
                columns = [pa.array(h.view(np.int64)), pa.array(more), batch.column(0).take(row), batch.column(1).take(row), pa.array(place.astype(np.int32))]
                return pa.RecordBatch.from_arrays(columns, ["hash", "more", "doc_id", "mark", "pos"])

            load = 0
            for i in range(batch.num_rows):
                words = (batch.column(2)[i].as_py() or "").lower().split()
                if load + len(words) > _GO and rows:
                    yield found()
                    rows, texts, load = [], [], 0
                rows.append(i)
                texts.append(words)
                load += len(words)
            if rows:
                yield found()

    return run


_SPAN = "hash long, more int, doc_id long, mark long, pos int"


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a hash other than its first one here. ``edge`` 1: the partition's first row; 2: the first row of its last hash.

    Rows that repeat whole (of documents that do) are one: a row equal to the first of its hash is no repeat.
    """
    part, last = TaskContext.get().partitionId(), None  # last: the first row of the open hash
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [pc.fill_null(c, 0).to_numpy() for c in batch.columns]
        fresh = np.r_[True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])]
        own = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))  # the first row of each row's hash in this batch
        goes_on = last is not None and tuple(k[0] for k in keys[:2]) == last[1][:2]
        equal = np.logical_and.reduce([k == np.where(own > 0, k[own], last[1][i] if goes_on else k[0]) for i, k in enumerate(keys)])
        edge = np.zeros(len(fresh), dtype=np.int32)
        if last is None:
            edge[0] = 1
        keep = ~equal | (edge > 0)
        picked = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(edge[keep]), pa.array(np.full(int(keep.sum()), part, dtype=np.int32))], [*batch.schema.names, "edge", "part"])
        if own[-1] or not goes_on:
            last = batch.slice(int(own[-1]), 1), tuple(k[own[-1]] for k in keys)
    if last is not None:
        yield pa.RecordBatch.from_arrays([*last[0].columns, pa.array([2], pa.int32()), pa.array([part], pa.int32())], [*last[0].schema.names, "edge", "part"])


def _mark(doc_id: Column, text: Column) -> Column:
    """64-bit mark that, with the id, tells rows apart where ids repeat."""
    return F.xxhash64(text, text.isNull(), doc_id.isNull())


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(doc_id.alias("doc_id"), _mark(doc_id, text).alias("mark"), text.alias("text"))


def repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """``doc_id, mark, repeats``: which of a document's spans are repeats, numbered in its order.

    The first occurrence of a span is that of the smallest id, then mark, then position. Defined cases: null and
    empty texts and those shorter than a span have none; rows that repeat an id and a text are one document here;
    null ids come first; an empty table gives no rows; texts of any length are hashed whole; other columns are ignored.
    """
    rows = _slim(docs, id_col, text_col).mapInArrow(_rows(min_sentences, min_words), _SPAN)
    order = ["hash", "more", "doc_id", "mark", "pos"]
    ranged = rows.repartitionByRange(partitions or shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    found = stable(ranged.mapInArrow(_repeats, _SPAN + ", edge int, part int"))
    # Two rows for each partition: its first row is a repeat if the hash that was open before it goes on.
    edges = found.where("edge > 0").collect()
    last, extra = None, []
    for r in sorted(edges, key=lambda r: (r["part"], r["edge"])):
        goes_on = last is not None and (last["hash"], last["more"]) == (r["hash"], r["more"])
        if r["edge"] == 1 and goes_on and tuple(r)[:5] != tuple(last)[:5]:
            extra.append(tuple(r)[2:5])
        if not goes_on:
            last = r
    more = docs.sparkSession.createDataFrame(extra, "doc_id long, mark long, pos int")
    return found.where("edge = 0").select("doc_id", "mark", "pos").unionByName(more).groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("repeats"))


def cut(text: str, repeats: list[int] | None, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> tuple[str, int]:
    """The text without the sentences that repeats cover, and their number; ``None``: every span is a repeat.

    A removed sentence takes the blanks after it along; all other characters stay.
    """
    lower = text.lower().split()
    *_, first, end = spans([lower], min_sentences, min_words)
    if not len(first):
        return text, 0
    _, at, _ = sentences([lower])
    which = np.arange(len(first)) if repeats is None else np.array(repeats, dtype=int)
    gone = np.zeros(len(at), dtype=int)
    np.add.at(gone, first[which], 1)
    np.subtract.at(gone, end[which], 1)
    gone = np.cumsum(gone)[:-1] > 0
    starts = [m.start() for m in _WORD.finditer(text)]
    begins = [0, *(starts[i] for i in at[1:-1].tolist()), len(text)]
    return "".join(text[begins[i] : begins[i + 1]] for i in np.flatnonzero(~gone)), int(gone.sum())


def dedup(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_removed``: every document without its repeated sentences, and how many these were.

    The first occurrence, by id, then by a hash of the text, then by position, stays. A repeat inside one document
    counts.

    Defined cases: null stays null and counts as empty; texts with fewer words or sentences than a span stay
    whole; of rows with equal id and text one is cut as if it stood alone, and the others lose every span, as each
    is there already; null ids come first, so theirs stay; an empty table gives no rows; texts of any length are
    cut whole; other columns are ignored.
    """
    slim = _slim(docs, id_col, text_col)
    hits = repeated_spans(docs, min_sentences, min_words, id_col, text_col).withColumnsRenamed({"doc_id": "hit_id", "mark": "hit_mark"})
    both = slim.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left").select("doc_id", "mark", "text", "repeats", F.lit(0).alias("copy"))
    again = stable(slim.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1"))
    if not again.isEmpty():
        # Copies are counted with their text aggregated in each task first, and dealt out again by their number.
        keyed = both.join(again.withColumnsRenamed({"doc_id": "again_id", "mark": "again_mark"}), F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("mark") == F.col("again_mark")), "left")
        copies = keyed.where("n IS NOT NULL").groupBy("doc_id", "mark").agg(F.first("text").alias("text"), F.first("repeats").alias("repeats"), F.first("n").alias("n"))
        copies = copies.select("doc_id", "mark", "text", "repeats", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))
        both = keyed.where("n IS NULL").select("doc_id", "mark", "text", "repeats", "copy").unionByName(copies)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist())
                done = [cut(t, None if c else r, min_sentences, min_words) if t and (c or r) else (t, 0) for t, r, c in rows]
                text, gone = zip(*done) if done else ([], [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_removed"])

    return both.drop("mark").mapInArrow(run, "doc_id long, text string, n_removed long")
