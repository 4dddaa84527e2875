"""Joins of rows with one row per key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot beyond this share of the rows, or of a quarter of a partition's mean, and never with fewer rows.
HOT_KEYS, LEAST_ROWS = 512, 128


def broadcast_small(side: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``side`` marked for a broadcast if its rows have at most ``most`` bytes as text; it is read for that, so it should be stored."""
    size = side.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(side) if size <= most else side


def hot_limit(total: int, partitions: int = 0) -> int:
    """Rows of a key, of ``total`` rows, beyond which it is hot: at most ``HOT_KEYS``, or four for each partition, are."""
    return max(LEAST_ROWS, total // max(HOT_KEYS, 4 * partitions))


def spread_join(rows: DataFrame, side: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows.join(side, key)`` without a task that gets all rows of a hot key.

    ``side`` has one row per key, whose ``count`` says how many of the ``total`` rows have it (and leaves the
    result). Hot keys, a few for each partition at most, are broadcast, so that their rows stay where they are; the others are shuffled. Both inputs are
    read more than once, so they should be stored or checkpointed. Null keys match nothing.
    """
    limit = hot_limit(total, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = side.where(F.col(count) > limit).drop(count)
    if many.isEmpty():
        return rows.join(side.drop(count), key)
    cold = rows.join(F.broadcast(many.select(key)), key, "left_anti")
    return rows.join(F.broadcast(many), key).unionByName(cold.join(side.where(F.col(count) <= limit).drop(count), key))
