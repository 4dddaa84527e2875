"""Boxes on a screen: nearest negatives, options that do not overlap, and coverage of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.vectors import iou


def centre(prefix: str = "") -> tuple[Column, Column]:
    c = lambda n: F.col(f"{prefix}{n}")
    return c("l") + c("w") / 2, c("t") + c("h") / 2


def with_target(df: DataFrame, group: str, is_target: Column) -> DataFrame:
    """Every element beside the target of its group, without a self-join: targets are a grouped maximum."""
    t = df.groupBy(group).agg(F.max(F.when(is_target, F.struct("element", "role", "l", "t", "w", "h"))).alias("target"))
    return df.join(t, group).where("target IS NOT NULL")


def negatives(df: DataFrame, group: str, is_target: Column) -> DataFrame:
    """Elements other than the target of their group, with their distance from it."""
    both = with_target(df, group, is_target).where(F.col("element") != F.col("target.element"))
    x, y = centre()
    tx, ty = centre("target.")
    return both.withColumn("distance", F.round(F.pow(x - tx, F.lit(2.0)) + F.pow(y - ty, F.lit(2.0)), 6))


def nearest_negatives(df: DataFrame, group: str, is_target: Column, k: int) -> DataFrame:
    """The k elements nearest to the target of their group, those of the same role first."""
    w = Window.partitionBy(group).orderBy((F.col("role") != F.col("target.role")).cast("int"), "distance", "element")
    return negatives(df, group, is_target).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def greedy_distinct(df: DataFrame, group: str, is_target: Column, k: int, limit: float = 0.1) -> DataFrame:
    """Up to k elements, nearest first, whose overlap with the target and with each chosen one is below ``limit``.

    The choice depends on the choices before: it is a fold over all elements of a group that are clear of the
    target, in the order of ``nearest_negatives``.
    """
    near = negatives(df, group, is_target).where(iou({c: F.col(c) for c in "ltwh"}, {c: F.col(f"target.{c}") for c in "ltwh"}) < limit)
    near = near.withColumn("other", (F.col("role") != F.col("target.role")).cast("int"))
    kind = near.select(F.struct("other", "distance", "element", "l", "t", "w", "h").alias("e")).schema["e"].dataType
    queue = near.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("other", "distance", "element", "l", "t", "w", "h"))).alias("_q"))
    box = lambda s: {c: s[c] for c in "ltwh"}
    accept = lambda out, s: (F.size(out) < k) & F.forall(out, lambda o: iou(box(s), box(o)) < limit)
    taken = F.aggregate("_q", F.array().cast(f"array<{kind.simpleString()}>"), lambda out, s: F.when(accept(out, s), F.concat(out, F.array(s))).otherwise(out))
    return queue.select(group, F.posexplode(taken).alias("_i", "_e")).select(group, F.col("_e.element").alias("element"), (F.col("_i") + 1).cast("long").alias("place"))


def point_coverage(df: DataFrame, group: str, is_target: Column, top: int = 10) -> DataFrame:
    """For each group, whether any box and whether one of the ``top`` by rank holds the target's centre."""
    both = with_target(df, group, is_target).where(F.col("element") != F.col("target.element"))
    tx, ty = centre("target.")
    holds = tx.between(F.col("l"), F.col("l") + F.col("w")) & ty.between(F.col("t"), F.col("t") + F.col("h"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("element"))
    return both.withColumn("_r", rank).groupBy(group).agg(F.bool_or(holds).alias("any_hit"), F.coalesce(F.bool_or(holds & (F.col("_r") <= top)), F.lit(False)).alias("top_hit"))
