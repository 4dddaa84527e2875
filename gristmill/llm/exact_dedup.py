"""Exact dedup: static binary-fuse filters per immutable snapshot screen incoming digests.

A *snapshot* is an immutable set of documents, reduced to its distinct digests and kept in buckets of the
digest space, each bucket with one binary-fuse filter. Digests of an incoming batch are grouped among
themselves first, then screened by the filter of their bucket: a negative is proved new; a positive joins the
bucket's exact digests, so a false positive costs one look-up and nothing else. Documents that share a digest
are then compared byte by byte with the text of the row that stays, and regrouped by their text where a
digest is shared by different texts.

``write_snapshot`` stores a snapshot once, its distinct texts beside digests and filters; ``against_snapshot``
screens later batches against it.

Only 40-byte digest rows are shuffled for grouping; texts move only where a digest has several rows.
Groups of any size are split by a salt before texts are compared, and no join sends the rows of a hot digest to one
task (``spread_join``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.skew import spread_join

from .common import stable

#: Keys that one bucket's filter holds on average; fixes filter size (about 9.1 bits a key) and build memory.
BUCKET_KEYS = 50_000
#: Rows of one group that one salt compares with the kept text.
SALT_ROWS = 512
#: Digests with several rows are broadcast only below this count (about 100 bytes each in the hash relation).
BROADCAST_DIGESTS = 400_000

_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of a splitmix step, on whole arrays."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class BinaryFuse8:
    """A static 3-wise binary-fuse filter with 8-bit fingerprints over distinct 64-bit keys.

    No false negatives; a false positive has probability 2**-8. Built by peeling in whole-array rounds.
    """

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        parts = (h & mask, (h >> np.uint64(18)) & mask, _mix(h, 0x51ED270B) & mask)
        return np.stack([(first + np.uint64(i)) * np.uint64(segment) + p for i, p in enumerate(parts)]).astype(np.int64)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuse8":
        keys = np.unique(np.asarray(keys, dtype=np.uint64))
        n = len(keys)
        segment = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1_000_000) / np.log(max(n, 3)))
        segments = max(1, int(np.ceil(max(n, 1) * factor / segment)) - 2)
        for seed in range(1, 200):
            h = _mix(keys, seed * 0x9E3779B97F4A7C15)
            slots = cls._slots(h, segment, segments)
            size = (segments + 2) * segment
            order = cls._peel(slots, size, n)
            if order is not None:
                cells, prints = np.zeros(size, dtype=np.uint8), cls._prints(h)
                for own, at in reversed(order):  # keys of one round never share their free cell
                    others = cells[slots[:, own]]
                    cells[at] = 0
                    hit = slots[:, own] == at
                    cells[at] = prints[own] ^ np.bitwise_xor.reduce(np.where(hit, 0, others), axis=0).astype(np.uint8)
                return cls(seed, segment, segments, cells)
            if seed % 20 == 0:
                segments += max(1, segments // 8)
        raise RuntimeError("no peelable seed")

    @staticmethod
    def _peel(slots: np.ndarray, size: int, n: int) -> list | None:
        count = np.bincount(slots.ravel(), minlength=size)
        ids = np.zeros(size, dtype=np.int64)
        np.bitwise_xor.at(ids, slots.ravel(), np.tile(np.arange(n), 3))
        todo, order, left = np.flatnonzero(count == 1), [], n
        while len(todo):
            own, pick = np.unique(ids[todo], return_index=True)
            at = todo[pick]
            order.append((own, at))
            left -= len(own)
            touched = slots[:, own].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(ids, touched, np.tile(own, 3))
            touched = np.unique(touched)
            todo = touched[count[touched] == 1]
        return order if left == 0 else None

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(np.asarray(keys, dtype=np.uint64), self.seed * 0x9E3779B97F4A7C15)
        slots = self._slots(h, self.segment, self.segments)
        return self._prints(h) == np.bitwise_xor.reduce(self.cells[slots], axis=0)


def normalised(text):
    """Null as empty; A-Z to lower case and nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digested(text_norm, digest_hex: int = 64):
    """Lower-case hex SHA-256, or its first ``digest_hex`` characters (for tests of shared digests)."""
    return F.substring(F.sha2(text_norm, 256), 1, digest_hex)


def _key64(digest):
    """Signed 64-bit key of a digest, for filters."""
    return F.xxhash64(digest)


def _bucket(digest, buckets: int):
    return F.pmod(F.hash(digest), F.lit(buckets))


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, seed, segment, segments, cells)``: one filter for each bucket of a snapshot's distinct digests."""

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse8.build(frame["key"].to_numpy(dtype=np.int64).view(np.uint64))
        return pd.DataFrame({"bucket": [int(frame["bucket"].iloc[0])], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "cells": [f.cells.tobytes()]})

    keyed = digests.select(_bucket(F.col("digest"), buckets).alias("bucket"), _key64(F.col("digest")).alias("key"))
    return keyed.groupBy("bucket").applyInPandas(make, "bucket int, seed int, segment int, segments int, cells binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Adds ``maybe``: false where the filter of the digest's bucket proves that the snapshot lacks it.

    ``incoming`` has distinct digests, so buckets stay even however often one text occurs.
    """

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(right) == 0:
            maybe = np.zeros(len(left), dtype=bool)
        else:
            r = right.iloc[0]
            f = BinaryFuse8(int(r["seed"]), int(r["segment"]), int(r["segments"]), np.frombuffer(r["cells"], dtype=np.uint8))
            maybe = f.contains(left["key"].to_numpy(dtype=np.int64).view(np.uint64))
        return left.drop(columns=["bucket", "key"]).assign(maybe=maybe)

    keyed = incoming.withColumn("bucket", _bucket(F.col("digest"), buckets)).withColumn("key", _key64(F.col("digest")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in incoming.schema) + ", maybe boolean"
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, fields)


def dedup(docs: DataFrame, in_snapshot, digest_hex: int = 64, id_col: str = "doc_id", text_col: str = "text", salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per document with its group of equal normalised texts.

    ``in_snapshot`` is a boolean column over ``docs`` that says which rows are the immutable snapshot; the rest
    is the incoming batch. Returns ``doc_id, keep_id, group_size, kept, text_sha256``.

    Defined cases: a null text counts as empty, and all empty texts are one group. Of equal texts the largest
    id stays. Repeated rows each give a row and count in ``group_size``; rows that repeat the kept id are all
    ``kept``. Null ids never win over others; where all ids of a group are null, ``keep_id`` is null and its
    rows are kept. Texts of any length are digested whole. An empty table gives an empty result. Further columns
    are ignored, whatever their names.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(in_snapshot, F.lit(False)).alias("old"), normalised(F.col(text_col)).alias("norm"))
    rows = stable(texts.select("doc_id", "old", F.sha2("norm", 256).alias("text_sha256")).withColumn("digest", F.substring("text_sha256", 1, digest_hex)))

    grouped = rows.groupBy("old", "digest").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    grouped = stable(grouped)
    snap = grouped.where("old").select("digest", F.col("top").alias("s_top"), F.col("n").alias("s_n"))
    batch = grouped.where("not old").select("digest", "top", "n")
    buckets = max(1, -(-snap.count() // BUCKET_KEYS))
    screened = stable(screen(batch, build_filters(snap, buckets), buckets))
    # Positives join the exact digests; what matches nothing on either side is a group of its own.
    merged = screened.where("maybe").select("digest", "top", "n").join(snap, "digest", "full_outer")
    groups = merged.select("digest", F.greatest("top", "s_top").alias("top"), (F.coalesce("n", F.lit(0)) + F.coalesce("s_n", F.lit(0))).alias("n"))
    groups = stable(groups.unionByName(screened.where("not maybe").select("digest", "top", "n")))

    multi = groups.where("n > 1").select("digest", F.col("top").alias("g_top"), F.col("n").alias("g_n"))
    odd = _different(texts, multi, digest_hex, salt_rows)
    odd = stable(odd)
    if odd.isEmpty():
        out = _rejoin(rows, groups)
    else:  # digests that different texts share: such rows are grouped anew by their whole text
        split = odd.select("digest").distinct()
        fine = texts.withColumn("digest", digested(F.col("norm"), digest_hex)).join(split, "digest", "left_semi")
        whole = fine.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
        fine = whole.select("keep_id", "n", F.sha2("norm", 256).alias("text_sha256"))
        sound = _rejoin(rows, groups.join(split, "digest", "left_anti"))
        again = spread_join(rows, stable(fine.withColumn("c", F.col("n"))), "text_sha256", "c", rows.count())
        out = sound.select("doc_id", "keep_id", "n", "text_sha256").unionByName(again.select("doc_id", "keep_id", "n", "text_sha256"))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _rejoin(rows: DataFrame, groups: DataFrame) -> DataFrame:
    sized = groups.select("digest", F.col("top").alias("keep_id"), "n", F.col("n").alias("c"))
    return spread_join(rows, sized, "digest", "c", groups.agg(F.sum("n")).first()[0] or 0)


def _different(texts: DataFrame, multi: DataFrame, digest_hex: int, salt_rows: int) -> DataFrame:
    """Digests of which some row's text is not, byte for byte, the text of the row that stays.

    ``multi``: digest, g_top, g_n of groups of several rows. A group is dealt over one salt for each
    ``salt_rows`` rows, and the kept text is copied to each salt, so no task holds a whole large group.
    """
    salts = F.ceil(F.col("g_n") / F.lit(salt_rows)).cast("int")
    number, total = multi.agg(F.count("*"), F.sum("g_n")).first()
    keyed = texts.withColumn("digest", digested(F.col("norm"), digest_hex))
    members = keyed.join(F.broadcast(multi), "digest") if number <= BROADCAST_DIGESTS else spread_join(keyed, multi.withColumn("c", F.col("g_n")), "digest", "c", total)
    tops = members.where(F.col("doc_id").eqNullSafe(F.col("g_top"))).groupBy("digest", "g_n").agg(F.max("norm").alias("top_norm"))
    tops = tops.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
    # A key of several rows with equal texts meets one copy of the kept text for each salt.
    both = dealt.select("digest", "salt", "norm").join(tops.select("digest", "salt", "top_norm"), ["digest", "salt"])
    return both.where(F.col("norm") != F.col("top_norm")).select("digest").distinct()


def write_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Stores ``docs`` as an immutable snapshot: ``path/grouped`` (``digest, top, n, norm``, one row for each
    distinct normalised text, ``top`` its largest id) and ``path/filters`` (one filter for each bucket, and their number).

    Defined cases are those of ``dedup``; an existing path is an error.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    # Texts are equal where their 256-bit digests are, so the map side already sends one text for each digest.
    grouped = texts.groupBy(F.sha2("norm", 256).alias("digest")).agg(F.max("doc_id").alias("top"), F.count("*").alias("n"), F.first("norm").alias("norm"))
    grouped.write.mode("errorifexists").parquet(f"{path}/grouped")
    spark = docs.sparkSession
    held = spark.read.parquet(f"{path}/grouped")
    buckets = max(1, -(-held.count() // BUCKET_KEYS))
    build_filters(held.select("digest"), buckets).withColumn("buckets", F.lit(buckets)).write.mode("errorifexists").parquet(f"{path}/filters")


def against_snapshot(spark: SparkSession, path: str, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_sha256, screened, in_snapshot, keep_id, batch_size, kept`` for each row of a batch.

    ``screened``: the filter of its bucket let the digest through; ``in_snapshot``: the snapshot holds the same bytes
    (``keep_id`` is then the snapshot's row); otherwise ``keep_id`` is the largest id of equal texts in the batch,
    ``batch_size`` their number, and ``kept`` says whether the row stays. Defined cases are those of ``dedup``.
    """
    held, filters = spark.read.parquet(f"{path}/grouped"), spark.read.parquet(f"{path}/filters")
    first = filters.agg(F.max("buckets")).first()[0]
    buckets = first or 1
    texts = batch.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("digest", F.sha2("norm", 256))
    rows = stable(texts.select("doc_id", "digest"))
    grouped = rows.groupBy("digest").agg(F.max("doc_id").alias("own"), F.count("*").alias("n"))
    screened = stable(screen(grouped, filters.drop("buckets"), buckets))
    # Only texts that the filters let through are read again, one of each, and compared byte by byte.
    asked = texts.join(screened.where("maybe").select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("norm").alias("norm"))
    same = asked.join(held.select("digest", F.col("top").alias("snapshot_id"), F.col("norm").alias("old")), "digest").where("norm = old").select("digest", "snapshot_id", F.lit(True).alias("in_snapshot"))
    judged = stable(screened.join(same, "digest", "left").select("digest", "own", "n", F.col("n").alias("c"), "maybe", "snapshot_id", F.coalesce("in_snapshot", F.lit(False)).alias("in_snapshot")))
    out = spread_join(rows, judged, "digest", "c", judged.agg(F.sum("n")).first()[0] or 0)
    keep = F.when(F.col("in_snapshot"), F.col("snapshot_id")).otherwise(F.col("own"))
    kept = ~F.col("in_snapshot") & F.col("doc_id").eqNullSafe(F.col("own"))
    return out.select("doc_id", F.col("digest").alias("text_sha256"), F.col("maybe").alias("screened"), "in_snapshot", keep.alias("keep_id"), F.col("n").alias("batch_size"), kept.alias("kept"))
