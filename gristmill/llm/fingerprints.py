"""Fingerprints of documents by a homomorphic multiset hash of their paragraphs.

A paragraph (a text's line between newlines) is hashed to a wide vector of two parts, and a document's fingerprint is
the sum of its paragraphs' vectors, each lane modulo a power of two. So the order of paragraphs does not matter, and a
paragraph is inserted or deleted by adding or subtracting its vector, without the rest of the text.

* 32 lanes modulo 2**64 from SHAKE-128 of the paragraph: they tell multisets of paragraphs apart.
* 512 lanes modulo 2**16: each byte of the paragraph, with up to 15 bytes before it in the paragraph, is a window, and
  each different window of the paragraph adds plus or minus the root of its count, rounded, to one lane (a count
  sketch). Inner products of these lanes estimate those of the windows' weights, so two fingerprints alone say how much
  two texts have in common; by the root, every byte of a text has about the same share in that, in a run of equal words too.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, shuffle_partitions

LANES, SKETCH = 32, 512
#: Bytes of a window, and bytes that are looked at in one go, so a long text needs no more memory than a short one. A
#: paragraph beyond that counts its windows in each stretch of so many bytes.
WINDOW, SLICE = 16, 1 << 18
_BYTES = LANES * 8 + SKETCH * 2
#: Masks that keep the last n bytes of a little-endian word, for n from 0 to 8.
_KEEP = np.array([0] + [((1 << 8 * n) - 1) << 8 * (8 - n) for n in range(1, 9)], dtype=np.uint64)


def _hashed(part: bytes, ahead: int) -> np.ndarray:
    """A number for the window that ends at each byte of ``part`` but the first ``ahead``, which go on a paragraph."""
    data = np.frombuffer(bytes(WINDOW) + part, dtype=np.uint8)
    place = np.arange(len(data))
    stops = np.where(data == 10, place, -1)
    stops[:WINDOW] = -1 if ahead else WINDOW - 1  # a paragraph starts where nothing goes ahead
    since = np.minimum(place - np.maximum.accumulate(stops), WINDOW)[WINDOW + ahead :]
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.tobytes(), strides=(1,))
    low, high = words[WINDOW + ahead - 7 :][: len(since)], words[WINDOW + ahead - 15 :][: len(since)]
    with np.errstate(over="ignore"):
        mixed = (low & _KEEP[np.minimum(since, 8)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed = (mixed + (high & _KEEP[np.maximum(since - 8, 0)])) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x94D049BB133111EB)
    return mixed


def _weighed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lane and sign of each different number (its highest bits), and the rounded root of its count."""
    numbers = np.sort(numbers)
    first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
    return (numbers[first] >> np.uint64(54)).astype(np.int64), np.rint(np.sqrt(np.diff(np.r_[first, len(numbers)])))


def _windows(raw: bytes) -> np.ndarray:
    """The sketch of all paragraphs of ``raw``, as int64 sums."""
    out, at = np.zeros(2 * SKETCH), 0
    while at < len(raw):
        stop = len(raw) if len(raw) - at <= SLICE else raw.rfind(b"\n", at, at + SLICE + 1)
        if stop >= at:  # some whole paragraphs
            mixed = _hashed(raw[at:stop], 0)
            ends = np.flatnonzero(np.frombuffer(raw[at:stop], dtype=np.uint8) == 10)
            found = [_weighed(mixed[a:b]) for a, b in zip([0, *(ends + 1).tolist()], [*ends.tolist(), len(mixed)]) if a < b]
            if found:
                lanes, weights = map(np.concatenate, zip(*found))
                out += np.bincount(lanes, weights, 2 * SKETCH)
        else:
            stop = raw.find(b"\n", at)
            stop = len(raw) if stop < 0 else stop
            for i in range(at, stop, SLICE):
                out += np.bincount(*_weighed(_hashed(raw[max(at, i - WINDOW) : min(i + SLICE, stop)], min(i - at, WINDOW))), 2 * SKETCH)
        at = stop + 1
    out = out.astype(np.int64)
    return out[:SKETCH] - out[SKETCH:]


class Fingerprint:
    """A sum of paragraph vectors that can be changed in place; ``str`` gives its text form."""

    __slots__ = ("lanes", "sketch")

    def __init__(self, lanes: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.lanes = np.zeros(LANES, dtype=np.uint64) if lanes is None else lanes
        self.sketch = np.zeros(SKETCH, dtype=np.int16) if sketch is None else sketch

    @classmethod
    def of(cls, raw: bytes) -> Fingerprint:
        """Of a whole text in UTF-8; a text without newlines is one paragraph, the empty text one empty paragraph."""
        sums = cls()
        digests = [hashlib.shake_128(p).digest(8 * LANES) for p in raw.split(b"\n")] if len(raw) <= SLICE else _digests(raw)
        some: list[bytes] = []
        for d in digests:
            some.append(d)
            if len(some) == 256:
                sums.lanes += np.frombuffer(b"".join(some), dtype="<u8").reshape(-1, LANES).sum(0, dtype=np.uint64)
                some = []
        sums.lanes += np.frombuffer(b"".join(some), dtype="<u8").reshape(-1, LANES).sum(0, dtype=np.uint64)
        sums.sketch = _windows(raw).astype(np.int16)
        return sums

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        if len(raw) != _BYTES:
            raise ValueError("not a fingerprint")
        return cls(np.frombuffer(raw[: 8 * LANES], dtype="<u8").astype(np.uint64), np.frombuffer(raw[8 * LANES :], dtype="<i2").astype(np.int16))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes + other.lanes, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes - other.lanes, self.sketch - other.sketch)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.lanes == other.lanes).all() and (self.sketch == other.sketch).all())

    __hash__ = None

    def __str__(self) -> str:
        return base64.b64encode(self.lanes.astype("<u8").tobytes() + self.sketch.astype("<i2").tobytes()).decode()

    def likeness(self, other: Fingerprint) -> float:
        """Estimated 2 * common / (own + other's) weight, as inner products: 1 for equal fingerprints, about 0 for texts without common windows.

        The standard error is about 0.04 for texts without anything in common, less the more they share. Exactly 1 if
        and only if the fingerprints are equal.
        """
        if self == other:
            return 1.0
        a, b = self.sketch.astype(np.int64), other.sketch.astype(np.int64)
        whole = int(a @ a + b @ b)
        return min(max(2 * int(a @ b) / whole, 0.0), 1 - 1e-9) if whole else 0.0


def _digests(raw: bytes) -> Iterator[bytes]:
    """Digests of the paragraphs of a long text, without a list of all of them."""
    at = 0
    while at >= 0:
        stop = raw.find(b"\n", at)
        yield hashlib.shake_128(raw[at:] if stop < 0 else raw[at:stop]).digest(8 * LANES)
        at = stop + 1 if stop >= 0 else -1


def edited(own: Fingerprint, text: str, keep: int, tail: str) -> tuple[str, Fingerprint]:
    """``text[:keep] + tail`` and its fingerprint, from ``own`` less the paragraphs that change plus what they become."""
    new = text[:keep] + tail
    start = text.rfind("\n", 0, keep) + 1
    old, changed = text[start:], new[start:]
    return new, own if old == changed else own - Fingerprint.of(old.encode()) + Fingerprint.of(changed.encode())


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and ``out``, the fingerprint of the whole text; no shuffle.

    A null text counts as empty; rows of any column names come back; ``out`` must not be among them.
    """
    (raw,) = fresh(docs, "_raw")

    @F.pandas_udf("string")
    def one(texts):
        return texts.map(lambda t: str(Fingerprint.of((t or "").encode())))

    return docs.withColumn(raw, F.coalesce(F.col(text_col), F.lit(""))).withColumn(out, one(F.col(raw))).drop(raw)


def merged(rows: DataFrame, by: list[str], fingerprint: str = "fingerprint") -> DataFrame:
    """One fingerprint of each group: that of all its paragraphs together. Tasks add up what they have first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, Fingerprint] = {}
        types = None
        for batch in batches:
            types = [c.type for c in batch.columns]
            for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text is not None:
                    sums[tuple(key)] = sums.get(tuple(key), Fingerprint()) + Fingerprint.parse(text)
            if len(sums) > 20_000:
                yield rows_of(sums, types)
                sums = {}
        if sums:
            yield rows_of(sums, types)

    def rows_of(sums, types):
        columns = [*zip(*sums), [str(f) for f in sums.values()]]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], [*by, fingerprint])

    slim = rows.select(*by, fingerprint)
    # Two levels, so no task gets more rows of a group than there are tasks at the level below.
    return slim.mapInArrow(add, slim.schema).repartition(shuffle_partitions(rows.sparkSession), *by).mapInArrow(add, slim.schema)


_NEXT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _below(cuts: list[int], x: Column) -> Column:
    """How many of the sorted ``cuts`` are below ``x``: first among every so many of them, then in that stretch."""
    step = max(1, math.isqrt(len(cuts)))
    count = lambda cs: F.array_size(F.filter(cs, lambda c: c < x))
    stretches = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = count(F.array(*(F.lit(s[-1]) for s in stretches)))
    fine = F.array(*(F.array(*map(F.lit, s)) for s in stretches))
    return coarse * step + F.coalesce(count(F.get(fine, coarse)), F.lit(0))


def _pieces(docs: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``piece``, ``guest`` and the rows: each piece holds a range of ids, and as guests the rows of the id after its last one.

    The driver holds the cuts between pieces and the first id of each, at most ``n`` numbers. The first piece follows the last.
    """
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    piece = F.coalesce(_below(cuts, F.col("doc_id")), F.lit(0)).cast("int") if cuts else F.lit(0)  # null ids are before all others
    found = ids.groupBy(piece.alias("piece")).agg(F.min("doc_id").alias("least"), F.bool_or(F.col("doc_id").isNull()).alias("null")).collect()
    order = sorted(r["piece"] for r in found)
    leasts, before, nulls = {r["piece"]: r["least"] for r in found}, dict(zip(order, [*order[-1:], *order])), any(r["null"] for r in found)
    last = max(order, default=0)
    by_piece = lambda numbers, kind: F.get(F.array(*(F.lit(numbers.get(p)).cast(kind) for p in range(last + 1))), F.col("piece"))
    first = (F.col("piece") > 0) & (F.col("doc_id") == by_piece(leasts, "long")) | (F.col("piece") == 0) & (F.col("doc_id").isNull() if nulls else F.col("doc_id") == by_piece(leasts, "long"))
    own = F.struct(F.col("piece"), F.lit(False).alias("guest"))
    guest = F.when(first, F.struct(by_piece(before, "int").alias("piece"), F.lit(True).alias("guest")))
    placed = docs.withColumn("piece", piece).withColumn("place", F.explode(F.array_compact(F.array(own, guest))))
    return placed.select("place.piece", "place.guest", *docs.columns), last + 1


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a sorted piece beside the next one; guests only follow."""
    held, out = None, []

    def row(one, after):
        doc_id, text, own = one
        share = len(text) // 4
        new, changed = edited(own, text, len(text) - share, after[1][:share])
        return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), str(own), str(changed), own.likeness(changed), own.likeness(after[2])

    names = [c.split()[0] for c in _NEXT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    ended = False
    for batch in batches:
        for guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if ended:
                continue
            now = (doc_id, text, Fingerprint.of(text.encode()))
            if held is not None:
                out.append(row(held, now))
            held, ended = now, guest
            if len(out) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to both the edited and the next text.

    The next document is that of the next id (after the last: the first); the edited text ends with the first code points
    of the next text in place of the last quarter of its own. ``n_chars`` counts code points of the text.

    Texts move once, to pieces of neighbouring ids; a piece also gets the row after its last one, so no task waits for
    another. Defined cases: a null text is empty; null ids come first; rows of the same id are neighbours, in the
    order of a hash of the text and the text; every row gives a row; a single row follows itself; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt, n = _pieces(rows, partitions or shuffle_partitions(docs.sparkSession))
    tie = F.xxhash64("text")
    sorted_ = dealt.repartitionById(n, F.col("piece")).sortWithinPartitions("guest", F.col("doc_id").asc_nulls_first(), tie, "text").select("guest", "doc_id", "text")
    return sorted_.mapInArrow(_neighbours, _NEXT)
