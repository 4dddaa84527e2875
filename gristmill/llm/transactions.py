"""Reassembly of interleaved transaction logs: undo chains, ordered commits, key-sharded replay, state digests.

A log record has a ``stream``, a place ``pos`` and an operation. Every stream runs successive transactions. Their
changes form a persistent cons list: a change is a new cell whose tail is the list so far, a savepoint stores the
head, a rollback walks from the head to the saved cell and emits what it undoes, an abort walks the whole list, and a
commit publishes it. Nothing is copied at a savepoint, and cells below a saved head are shared with it.

One stream may hold a third of all records, and one transaction may be as long as its stream. So records are
range-partitioned by stream and place, each task runs the chains of its piece of the log, and what is open at a piece's
end is settled by the first control records of the pieces after it, of which there is one row per stream and task.
Texts never move: a change carries the number that its value counts with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gristmill.operators.sampling import ranked

from .common import shuffle_partitions, stable

#: Operations of a log record, by name.
CHANGE, SAVEPOINT, ROLLBACK, COMMIT, ABORT = "change", "savepoint", "rollback", "commit", "abort"
_CODES = {name: code for code, name in enumerate((CHANGE, SAVEPOINT, ROLLBACK, COMMIT, ABORT))}
_NAMES = list(_CODES)
#: Rows of a piece's output: fate known; open and not kept by a savepoint of its piece; open and kept; the piece itself.
_DONE, _LOOSE, _HELD, _PIECE = range(4)
#: Rows that a task holds before it hands them on.
_FLUSH = 50_000


@dataclass
class Replay:
    """What a log comes to; frames are stored, so that each may be used alone.

    ``undone``: ``pos, key, kind`` (``rollback`` or ``abort``) and ``by``, the place of the record that undid it (null: the
    log ended). ``applied``: ``pos, key, value, seq``, ``seq`` counting commits of the whole log from 0. ``commits``:
    ``stream, pos, seq``.
    """

    undone: DataFrame
    applied: DataFrame
    commits: DataFrame

    def store(self) -> DataFrame:
        """``key, value`` of the shared store after the last commit; deleted keys are absent."""
        return _last_values(self.applied, F.lit(0)).where("value IS NOT NULL").select("key", "value")

    def states(self, per_epoch: int) -> DataFrame:
        """``epoch, n, total`` after each ``per_epoch`` commits and after the last: stored keys and the sum of their values."""
        epoch = (F.floor(F.col("seq") / per_epoch) + 1).cast("long")
        finals = _last_values(self.applied, epoch)
        n = shuffle_partitions(finals.sparkSession)
        key = finals.schema["key"]
        row = StructType([StructField("part", IntegerType()), StructField("epoch", LongType()), StructField("n", LongType()), StructField("total", LongType()),
                          StructField("key", key.dataType), StructField("last_key", key.dataType), StructField("last_n", LongType()), StructField("last_total", LongType())])
        steps = stable(finals.repartitionByRange(n, "key", "epoch").sortWithinPartitions("key", "epoch").select("key", "epoch", "value").mapInArrow(_steps, row))
        # A piece takes its first key for a new one. Where the piece before ends with that key, its value is taken off.
        edges = steps.where("last_n IS NOT NULL")
        before = [F.lag(c).over(Window.orderBy("part")).alias(f"_{c}") for c in ("last_key", "last_n", "last_total")]
        mends = edges.select("part", "key", "epoch", *before).where("_last_n IS NOT NULL AND key <=> _last_key").select("epoch", (-F.col("_last_n")).alias("n"), (-F.col("_last_total")).alias("total"))
        base = self.commits.select(epoch.alias("epoch")).distinct().select("epoch", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))
        parts = steps.where("last_n IS NULL").select("epoch", "n", "total").unionByName(mends).unionByName(base)
        return _running(parts.groupBy("epoch").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), n)


def _last_values(applied: DataFrame, epoch) -> DataFrame:
    """``key, epoch, value``: the last value of each key in each epoch, by partial aggregation, however hot a key is."""
    order = F.struct("seq", "pos", "value")
    return applied.groupBy("key", epoch.cast("long").alias("epoch")).agg(F.max_by("value", order).alias("value"))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How count and sum change with each row of sorted ``key, epoch, value``, and the piece's first and last key."""
    part, first, last, last_n, last_total = TaskContext.get().partitionId(), None, None, 0, 0
    for batch in batches:
        key, epoch, value = batch.columns
        if not len(key):
            continue
        tail = pa.array([None if first is None else last], key.type)
        prior = pa.concat_arrays([tail, key.slice(0, len(key) - 1)])
        both_null = pc.and_(pc.is_null(key), pc.is_null(prior))
        same = pc.or_(pc.fill_null(pc.equal(key, prior), False), both_null).to_numpy(zero_copy_only=False).copy()
        same[0] &= first is not None
        has = pc.is_valid(value).to_numpy(zero_copy_only=False).astype(np.int64)
        total = pc.fill_null(value, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        dn, dt = has - same * np.r_[last_n, has[:-1]], total - same * np.r_[last_total, total[:-1]]
        if first is None:
            first = (key[0].as_py(), epoch[0].as_py())
        last, last_n, last_total = key[-1].as_py(), int(has[-1]), int(total[-1])
        nulls = [pa.nulls(len(key), t) for t in (key.type, key.type, pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), part, np.int32)), epoch, pa.array(dn), pa.array(dt), *nulls], ["part", "epoch", "n", "total", "key", "last_key", "last_n", "last_total"])
    if first is not None:
        one = [pa.array([v], t) for v, t in ((part, pa.int32()), (first[1], pa.int64()), (None, pa.int64()), (None, pa.int64()), (first[0], key.type), (last, key.type), (last_n, pa.int64()), (last_total, pa.int64()))]
        yield pa.RecordBatch.from_arrays(one, ["part", "epoch", "n", "total", "key", "last_key", "last_n", "last_total"])


def _running(df: DataFrame, n: int) -> DataFrame:
    """``epoch, n, total`` with running sums over all epochs: sums within each piece, and those of the pieces before."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept = TaskContext.get().partitionId(), [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = []
            for i, c in enumerate(batch.columns[1:]):
                run = np.cumsum(c.to_numpy(zero_copy_only=False).astype(np.int64)) + kept[i]
                kept[i] = int(run[-1])
                columns.append(pa.array(run))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), batch.columns[0], *columns], ["part", "epoch", "n", "total"])

    local = stable(df.select("epoch", "n", "total").repartitionByRange(n, "epoch").sortWithinPartitions("epoch").mapInArrow(sums, "part int, epoch long, n long, total long"))
    ends = local.groupBy("part").agg(F.max_by(F.struct("n", "total"), "epoch").alias("end"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ends.select(F.col("part").alias("_part"), *[F.coalesce(F.sum(f"end.{c}").over(ahead), F.lit(0)).alias(f"_{c}") for c in ("n", "total")])
    return local.join(shifts, F.col("part") == F.col("_part")).select("epoch", (F.col("n") + F.col("_n")).alias("n"), (F.col("total") + F.col("_total")).alias("total"))


_TAIL = ["role", "part", "pos", "value", "fate", "by", "seq", "end_fate", "end_by", "end_seq"]


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains of one task: sorted rows of ``stream, pos, op, key, value, seq`` to rows of ``_TAIL``, stream and key."""
    part, types = TaskContext.get().partitionId(), []
    out: list[tuple] = []
    #: A cell is ``(pos, key, value, tail)``; ``saved`` is the head that the latest savepoint stored (None: the piece's start).
    stream, head, saved, control, end, began = None, None, None, None, None, False

    def walk(to, role, fate, by, seq):
        """Emits the cells from the head down to the cell ``to``, which is the new head."""
        cell = head
        while cell is not to:
            out.append((role, part, cell[0], cell[2], fate, by, seq, None, None, None, stream, cell[1]))
            cell = cell[3]
        return to

    def close():
        nonlocal head
        head = walk(saved, _LOOSE, None, None, None)
        walk(None, _HELD, None, None, None)
        out.append((_PIECE, part, None, None, *(control or (None,) * 3), *(end or (None,) * 3), stream, None))

    def handed():
        """What has been emitted so far, in batches of a bounded size."""
        for at in range(0, len(out), _FLUSH):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[at : at + _FLUSH]), types)], [*_TAIL, "stream", "key"])
        out.clear()

    for batch in batches:
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), batch.schema.field(0).type, batch.schema.field(3).type]
        for s, pos, op, key, value, seq in zip(*(c.to_pylist() for c in batch.columns)):
            if not began or s != stream:
                if began:
                    close()
                stream, head, saved, control, end, began = s, None, None, None, None, True
            if op == 0:
                head = (pos, key, value, head)
                continue
            control = control or (op, pos, seq)
            if op == _CODES[SAVEPOINT]:
                saved = head
            elif op == _CODES[ROLLBACK]:
                head = walk(saved, _DONE, op, pos, None)
            else:
                end = end or (op, pos, seq)
                head, saved = walk(None, _DONE, op, pos, seq), None
            if len(out) >= _FLUSH:
                yield from handed()
    if began:
        close()
        yield from handed()


def replay(log: DataFrame) -> Replay:
    """Replays ``log``: columns ``stream, pos, op, key, value``; ``value`` (long, null deletes the key) is what states sum.

    Transactions of a stream follow each other; each ends with a commit, an abort or the log (which aborts it). A rollback
    undoes what its transaction still holds since its latest savepoint, or its start, and keeps that savepoint. Commits
    apply to one store in the order of ``pos`` over all streams.

    Defined cases: a null stream is a stream, a null key a key; a record with a null ``pos`` or another ``op`` has no place in
    the log and is left out; records with the same ``stream`` and ``pos`` run in the order change, savepoint, rollback, commit,
    abort and by value (nulls first), commits of the same ``pos`` by stream; repeated rows each count; an empty log has
    no commits, so no states.
    """
    spark = log.sparkSession
    n = shuffle_partitions(spark)
    code = F.create_map(*(F.lit(x) for pair in _CODES.items() for x in pair))[F.col("op")]
    rows = log.select("stream", F.col("pos").cast("long").alias("pos"), code.alias("op"), "key", F.col("value").cast("long").alias("value")).where("pos IS NOT NULL AND op IS NOT NULL")
    commits = stable(ranked(rows.where(F.col("op") == _CODES[COMMIT]).select("stream", "pos"), [], [F.col("pos"), F.col("stream")], "seq", n))
    no_key = F.lit(None).cast(rows.schema["key"].dataType)
    ends = commits.select("stream", "pos", F.lit(_CODES[COMMIT]).alias("op"), no_key.alias("key"), F.lit(None).cast("long").alias("value"), "seq")
    whole = rows.where(F.col("op") != _CODES[COMMIT]).withColumn("seq", F.lit(None).cast("long")).unionByName(ends)
    order = ["stream", "pos", "op", "value", "seq"]
    dealt = whole.repartitionByRange(n, *order).sortWithinPartitions(*order).select("stream", "pos", "op", "key", "value", "seq")
    kinds = {"role": "int", "part": "int", "fate": "int", "end_fate": "int"}
    schema = StructType([*(StructField(c, IntegerType() if c in kinds else LongType()) for c in _TAIL), StructField("stream", rows.schema["stream"].dataType), StructField("key", rows.schema["key"].dataType)])
    run = stable(dealt.mapInArrow(_chains, schema))

    # What is open at a piece's end meets the first control record after it, and the first end of a transaction.
    later = Window.partitionBy("stream").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    one = lambda p: F.when(F.col(f"{p}fate").isNotNull(), F.struct(F.col(f"{p}fate").alias("fate"), F.col(f"{p}by").alias("by"), F.col(f"{p}seq").alias("seq")))
    nearest = lambda p: F.last(one(p), ignorenulls=True).over(later)
    fates = run.where(F.col("role") == _PIECE).select(F.col("part").alias("_part"), F.col("stream").alias("_stream"), nearest("").alias("_control"), nearest("end_").alias("_end"))
    kept = (F.col("role") == _HELD) | (F.col("_control.fate") == _CODES[SAVEPOINT])
    fate = F.when(kept, F.col("_end")).otherwise(F.col("_control"))
    opened = run.where(F.col("role").isin(_LOOSE, _HELD)).join(fates, (F.col("part") == F.col("_part")) & F.col("stream").eqNullSafe(F.col("_stream")))
    settled = opened.withColumn("_fate", fate).select("pos", "key", "value", F.coalesce("_fate.fate", F.lit(_CODES[ABORT])).alias("fate"), F.col("_fate.by").alias("by"), F.col("_fate.seq").alias("seq"))
    done = stable(run.where(F.col("role") == _DONE).select("pos", "key", "value", "fate", "by", "seq").unionByName(settled))
    name = F.element_at(F.array(*map(F.lit, _NAMES)), F.col("fate") + 1)
    undone = done.where(F.col("fate") != _CODES[COMMIT]).select("pos", "key", name.alias("kind"), "by")
    return Replay(undone, done.where(F.col("fate") == _CODES[COMMIT]).select("pos", "key", "value", "seq"), commits)


def log_of(docs: DataFrame, labels: DataFrame, keys: int = 30_000) -> DataFrame:
    """Documents as log records: operation and key by crc32 of the id, value by crc32 of ``key:text``.

    A null text, or an id that a row of ``labels`` calls toxic, deletes the key. Only numbers are shuffled.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    m = h % 17
    op = F.when(m < 2, COMMIT).when(m < 3, ABORT).when(m < 5, SAVEPOINT).when(m < 7, ROLLBACK).otherwise(CHANGE)
    key = F.when(m >= 7, F.floor(h / 100).cast("long") % keys)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("stream"), op.alias("op"), key.alias("key"), F.when(m >= 7, F.crc32(F.concat_ws(":", key, F.col("text")))).alias("value"), F.col("text").isNull().alias("gone"))
    toxic = labels.where("toxic = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("toxic")).distinct()
    return rows.join(toxic, "doc_id", "left").select("stream", F.col("doc_id").alias("pos"), "op", "key", F.when(~F.col("gone") & F.col("toxic").isNull(), F.col("value")).alias("value"))


def reassembly(docs: DataFrame, labels: DataFrame, per_epoch: int = 64) -> DataFrame:
    """``kind, id, n, value``: a ``state`` for each epoch (number, stored keys, sum), and each undone change with what undid it."""
    found = replay(log_of(docs, labels))
    undone = found.undone.select("kind", F.col("pos").alias("id"), F.col("by").alias("n"), F.col("key").alias("value"))
    states = found.states(per_epoch).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", F.col("total").alias("value"))
    return undone.unionByName(states)
