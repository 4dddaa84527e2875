"""Hash-ranked quotas, round-robins, slots, spreads, shards and packs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.hashing import bucket, digest
from gristmill.lineage import stable
from gristmill.operators.skew import spread_join


def hash_top(df: DataFrame, n: int, *key: str, seed: str = "") -> DataFrame:
    """The ``n`` rows of the smallest digest: a top-k without a full sort."""
    return df.withColumn("_r", digest(F.lit(seed), *key)).orderBy("_r", *key).limit(n).drop("_r")


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values with their counts ``n``; ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def epoch_order(df: DataFrame, epoch: int, *key: str, seed: str = "epoch") -> DataFrame:
    """Rows with ``turn``, a digest by which each epoch has an order of its own; ties by key."""
    return df.withColumn("turn", digest(F.lit(seed), F.lit(epoch), *key))


def replay(base: DataFrame, pool: DataFrame, ratio: float, epoch: int, *key: str, seed: str = "replay") -> DataFrame:
    """``base`` and ``ratio`` times as many rows of ``pool``, drawn anew for each epoch by hash, in the epoch's order."""
    n = int(ratio * base.count())
    return epoch_order(base.unionByName(hash_top(pool, n, *key, seed=f"{seed}:{epoch}")), epoch, *key)


def ranked(df: DataFrame, by: list[str], order: list, out: str, partitions: int | None = None) -> DataFrame:
    """``row_number() - 1`` within ``by``, however many rows one key has.

    Rows are range-partitioned by key and order, so a large key lies in many partitions; each counts its own rows, and
    the counts of the pieces before are added. Order ties are broken arbitrarily but once, as rows are checkpointed.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    dealt = stable(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    pieces = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_part").alias("_piece"), (before - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_piece")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = dealt.join(pieces, same)
    return joined.withColumn(out, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_piece", "_shift", *[f"_k{i}" for i in range(len(by))])


#: Largest rank by which Spark lets each task drop rows before a window's shuffle (its default threshold).
GROUP_LIMIT = 1000


def by_cut(df: DataFrame, strata: list[str], order: list, quota: int | DataFrame, digits: int = 3) -> DataFrame:
    """The first ``quota`` rows of each stratum by ``order``, which begins with a hex digest; no stratum is ever sorted.

    A histogram of the digest's first ``digits`` digits says which bin holds a stratum's last row. Rows of lower bins are
    in, and only those of the bin at the cut are ranked: one in 4,096 of a stratum (three digits; more for strata beyond 1e10
    rows). ``quota`` is a number or a table of strata with a column ``quota``; strata without one give no rows.
    """
    key, bin_, first = "_stratum", "_bin", order[0] if isinstance(order[0], Column) else F.col(order[0])
    number = F.conv(F.substring(first, 1, digits), 16, 10).cast("int")
    rows = df.withColumn(key, F.struct(*strata)).withColumn(bin_, number)
    bins = rows.groupBy(key, bin_).agg(F.count("*").alias("_n"))
    if isinstance(quota, DataFrame):
        bins = bins.join(quota.select(F.struct(*strata).alias(key), F.col("quota").alias("_quota")), key)
    else:
        bins = bins.withColumn("_quota", F.lit(quota))
    up = Window.partitionBy(key).orderBy(bin_)  # 4,096 rows at most
    bins = bins.withColumn("_before", F.sum("_n").over(up) - F.col("_n"))
    reached = F.when(F.col("_before") < F.col("_quota"), F.struct(F.col(bin_).alias("bin"), (F.col("_quota") - F.col("_before")).alias("left")))
    cuts = stable(bins.groupBy(key).agg(F.max(reached).alias("_cut"), F.sum("_n").alias("_rows")).where("_cut IS NOT NULL"))
    kept = spread_join(rows, cuts, key, "_rows", cuts.agg(F.sum("_rows")).first()[0] or 0).where(F.col(bin_) <= F.col("_cut.bin"))
    at_cut = F.when(F.col(bin_) == F.col("_cut.bin"), F.lit(True))
    place = F.row_number().over(Window.partitionBy(key, bin_).orderBy(*order))
    last = kept.where(at_cut).withColumn("_place", place).where(F.col("_place") <= F.col("_cut.left")).drop("_place")
    return kept.where(at_cut.isNull()).unionByName(last).drop(key, bin_, "_cut")


def stratum_quota(df: DataFrame, strata: list[str], order: list, quota: int | DataFrame) -> DataFrame:
    """First rows of each stratum; ``quota`` is a number or a table of strata with a column ``quota``.

    Small quotas are filled within each task first; for a table, or more than 1,000 rows, ``order`` must begin with a hex
    digest (see ``by_cut``).
    """
    if not isinstance(quota, int) or quota > GROUP_LIMIT:
        return by_cut(df, strata, order, quota)
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))
    return ranked.where(F.col("_rn") <= quota).drop("_rn")


def balanced(df: DataFrame, task: str, per_task: int, order: list, index: str) -> DataFrame:
    """``per_task`` rows of each task by ``order``, back in the order of the source with their new ``place``."""
    return stratum_quota(df, [task], order, per_task).orderBy(index)


def class_cap_union(df: DataFrame, label: str, cap: int, rest: int, order: list) -> DataFrame:
    """``cap`` rows of each class, then ``rest`` of what is left overall.

    Of a class no more than ``cap + rest`` rows can be in the result, so no class is sorted beyond that.
    """
    place = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    ranked = stable(stratum_quota(df, [label], order, cap + rest).withColumn("_rn", place))
    return ranked.where(F.col("_rn") <= cap).unionByName(ranked.where(F.col("_rn") > cap).orderBy(*order).limit(rest)).drop("_rn")


def round_robin(df: DataFrame, source: str, label: str, order: list, cap: int, from_end: bool = False) -> DataFrame:
    """One row of each label in turn, up to ``cap`` rows a source, with the turn ``k``.

    Labels give their first rows by ``order``, or with ``from_end`` their last. A label gives ``cap`` rows at most, which
    each task picks before rows are shuffled.
    """
    order = [F.desc_nulls_last(c) if isinstance(c, str) else c.desc_nulls_last() for c in order] if from_end else order
    inner = df.withColumn("_rn", F.row_number().over(Window.partitionBy(source, label).orderBy(*order))).where(F.col("_rn") <= cap)
    outer = inner.withColumn("k", F.row_number().over(Window.partitionBy(source).orderBy("_rn", label)))
    return outer.where(F.col("k") <= cap).drop("_rn")


def quota_with_fallback(df: DataFrame, modality: str, family: str, order: list, family_quota: int, totals: DataFrame) -> DataFrame:
    """Family quotas first; a modality short of its total is filled by rank from what is left.

    No family gives more rows than the largest total, so that many of each are picked in each task first.
    """
    most = totals.agg(F.max("total")).first()[0] or 0
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(modality, family).orderBy(*order))).where(F.col("_rn") <= max(most, family_quota))
    first = ranked.withColumn("_pass", F.when(F.col("_rn") <= family_quota, 1).otherwise(2))
    placed = first.withColumn("_k", F.row_number().over(Window.partitionBy(modality).orderBy("_pass", *order))).where(F.col("_k") <= most)
    return placed.join(totals, modality).where("_k <= total").withColumnRenamed("_pass", "pass").drop("_rn", "_k", "total")


def gold_slots(df: DataFrame, order: list, slots: int, by: list[str]) -> DataFrame:
    """Gold places dealt in turn by rank within ``by``, so each place is used equally often."""
    return ranked(df, by, order, "slot").withColumn("slot", F.col("slot") % slots)


def spread_index(n: Column, k: int) -> Column:
    """``k`` places evenly from first to last of ``n``; halves go to the even neighbour."""
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    return F.transform(steps, lambda i: F.bround(i * (n - 1) / F.lit(float(max(k - 1, 1)))).cast("int"))


def midpoint_index(n: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor((i + 0.5) * n / k).cast("int"))


def sharded(df: DataFrame, n: int, *key: str) -> DataFrame:
    return df.withColumn("shard", bucket(digest(*key), n))


def packed(df: DataFrame, by: list[str], order: list, size: int = 64) -> DataFrame:
    """Pack and place in the pack of each row, by rank within ``by``."""
    placed = ranked(df, by, order, "_rank")
    return placed.withColumn("pack", F.floor(F.col("_rank") / size).cast("long")).withColumn("place", (F.col("_rank") % size).cast("int")).drop("_rank")


def spread_blocks(df: DataFrame, index: str, n: int, blocks: int, size: int) -> DataFrame:
    """Rows of evenly spread blocks of consecutive indexes."""
    starts = [0] if blocks == 1 else [round(i * (n - size) / (blocks - 1)) for i in range(blocks)]
    wanted = None
    for s in starts:
        part = F.col(index).between(s, s + size - 1)
        wanted = part if wanted is None else wanted | part
    return df.where(wanted)


def interleave(df: DataFrame, stratum: str, row: str, hard: str, diverse: str, take: int) -> DataFrame:
    """Within each stratum, rows by the hard and by the diverse rank in turn, each row once; ``turn`` counts.

    The merge skips rows already taken, so it is stateful. No more than the ``take`` best of either rank can be met, and
    each task picks these before rows are shuffled, so a group never exceeds ``2 * take`` rows.
    """
    rank = lambda q, *order: df.select(stratum, row, F.lit(q).alias("q"), F.row_number().over(Window.partitionBy(stratum).orderBy(*order)).alias("at")).where(F.col("at") <= take)
    bounded = rank(0, F.desc(hard), row).unionByName(rank(1, diverse, row))

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        queues = [g[g["q"] == q].sort_values("at")[row].tolist() for q in (0, 1)]
        at, seen, out = [0, 0], set(), []
        while len(out) < min(take, len(queues[0])):
            q = len(out) % 2
            while queues[q][at[q]] in seen:
                at[q] += 1
            seen.add(queues[q][at[q]])
            out.append(queues[q][at[q]])
        return pd.DataFrame({stratum: [g[stratum].iloc[0]] * len(out), row: out, "turn": range(len(out))})

    kinds = dict(df.dtypes)
    return bounded.groupBy(stratum).applyInPandas(merge, f"`{stratum}` {kinds[stratum]}, `{row}` {kinds[row]}, turn long")


def sqrt_inverse_weights(df: DataFrame, source: str) -> DataFrame:
    """Per source sqrt(N / (S * n_s)); counts are aggregated before anything is joined."""
    counts = df.groupBy(source).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_N"), F.count("*").alias("_S"))
    return counts.crossJoin(F.broadcast(whole)).select(source, "n", F.sqrt(F.col("_N") / (F.col("_S") * F.col("n"))).alias("weight"))
