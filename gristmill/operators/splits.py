"""Split assignment policies: pure functions of stable keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.hashing import bucket, digest, full_mod

#: Splits by how protected they are.
SPLITS = ["train", "dev", "calibration", "test"]


def priority(split: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, SPLITS)), split) - 1).cast("int")


def ladder(value: Column, steps: list[tuple[int, str]], last: str) -> Column:
    """The first name whose bound is above ``value``."""
    out = None
    for bound, name in steps:
        out = F.when(value < bound, name) if out is None else out.when(value < bound, name)
    return out.otherwise(last)


# The bounds of buckets that splits begin at.
LADDER = ((60, "train"), (70, "dev"), (85, "calibration"))


def hashed(*key: Column | str, full: bool = False, steps=LADDER, last: str = "test") -> Column:
    """Buckets of 100 of the key's digest; ``full`` takes all 256 bits instead of the first 32."""
    d = digest(*key)
    # A name for each bucket: a ladder would compute the bucket for each of its steps.
    names = F.array(*[F.lit(next((name for bound, name in steps if i < bound), last)) for i in range(100)])
    return F.get(names, full_mod(d, 100) if full else bucket(d, 100))


def official_first(official: Column, fallback: Column, mapping: dict[str, str]) -> Column:
    """The publisher's split where it is mapped, else ``fallback``."""
    out = None
    for theirs, ours in mapping.items():
        out = F.when(official == theirs, ours) if out is None else out.when(official == theirs, ours)
    return out.otherwise(fallback) if out is not None else fallback


def move_rare(df: DataFrame, group: str, label: Column, into: str = "calibration", rank: Column | None = None) -> DataFrame:
    """If no row of ``into`` has the label, the first train group by rank that holds it moves there."""
    rank = digest(group) if rank is None else rank
    have = df.where((F.col("split") == into) & label).limit(1).agg(F.count("*").alias("_have"))
    first = df.where((F.col("split") == "train") & label).select(group, rank.alias("_r")).distinct().orderBy("_r", group).limit(1).select(F.col(group).alias("_move"))
    # Both are one row at most.
    marked = df.crossJoin(F.broadcast(have)).join(F.broadcast(first), F.col(group) == F.col("_move"), "left")
    moves = (F.col("_have") == 0) & F.col("_move").isNotNull() & (F.col("split") == "train")
    return marked.withColumn("split", F.when(moves, into).otherwise(F.col("split"))).drop("_have", "_move")


def forced(df: DataFrame, family: str, into: str) -> DataFrame:
    """Families of a single row go to one split; only names of such families are joined."""
    single = df.where(F.col(family).isNotNull()).groupBy(family).agg(F.count("*").alias("_n")).where("_n = 1")
    return df.join(single, family, "left").withColumn("split", F.when(F.col("_n") == 1, into).otherwise(F.col("split"))).drop("_n")


def publisher_split(source: Column, original: Column, group: Column, as_test: dict[str, str] | None = None) -> Column:
    """The publisher's split, and rows held back from train by group.

    ``validation`` and ``dev`` are dev; what begins with ``test`` or ``validation_`` is test. ``as_test`` names sources
    without a test split, and the split of theirs that stands for it. Of the groups of train, buckets 95 to 99 of the
    digest of source and group are calibration, 90 to 94 dev.
    """
    instead = F.lit(False)
    for name, split in (as_test or {}).items():
        instead = instead | ((source == name) & (original == split))
    theirs = F.when(instead, "test").when(original.isin("validation", "dev"), "dev").when(original.startswith("test") | original.startswith("validation_"), "test")
    held = bucket(F.sha2(F.concat(source, group.cast("string")), 256), 100)
    return F.coalesce(theirs, F.when(held >= 95, "calibration").when(held >= 90, "dev").otherwise("train"))
