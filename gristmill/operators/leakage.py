"""Leakage guards: rows that share keys across splits, owners of keys, overlaps, duplicates and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.lineage import stable

from .sampling import ranked
from .skew import spread_join
from .splits import priority


def tagged_keys(df: DataFrame, row: str, keys: dict[str, Column], *carry: str) -> DataFrame:
    """One narrow row for each row and key; null keys are dropped."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("key")) for k, v in keys.items()])
    return df.select(row, *carry, F.explode(pairs).alias("_k")).select(row, *carry, "_k.kind", "_k.key").where("key IS NOT NULL")


def _at_keys(own: DataFrame, total: int, *aggregates: Column, where: str) -> DataFrame:
    """Rows of ``tagged_keys`` beside what is aggregated over their key, for keys that meet ``where``; no key's rows gather."""
    one = own.withColumn("_at", F.struct("kind", "key"))
    side = stable(one.groupBy("_at").agg(F.count("*").alias("_c"), *aggregates).where(where))
    return spread_join(one, side, "_at", "_c", total)


def owner_split(df: DataFrame, row: str, keys: dict[str, Column]) -> DataFrame:
    """Rows of which no key is owned by a more protected split; one pass, so dropped rows still own.

    The keys of a key group meet as pre-aggregated (key, highest priority) rows only.
    """
    own = stable(tagged_keys(df.withColumn("_p", priority(F.col("split"))), row, keys, "_p"))
    mixed = _at_keys(own, own.count(), F.max("_p").alias("_owner"), F.min("_p").alias("_least"), where="_owner > _least")
    return df.join(mixed.where("_owner > _p").select(row).distinct(), row, "left_anti")


def multi_key_anti(df: DataFrame, row: str, keys: dict[str, Column], held_out=("dev", "calibration", "test")) -> DataFrame:
    """Train rows that share any key with a held-out row go; held-out rows stay."""
    own = stable(tagged_keys(df, row, keys, "split"))
    train, held = F.col("split") == "train", F.col("split").isin(*held_out)
    met = _at_keys(own, own.count(), F.bool_or(train).alias("_train"), F.bool_or(held).alias("_held"), where="_train AND _held")
    return df.join(met.where(train).select(row).distinct(), row, "left_anti")


def protected_anti(df: DataFrame, key: str, protected: DataFrame, when: Column | None = None) -> DataFrame:
    """Rows whose key is protected go, where ``when`` holds."""
    hit = protected.select(F.col(key).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    marked = df.join(hit, F.col(key) == F.col("_key"), "left")
    return marked.where(F.col("_hit").isNull() | ~(F.lit(True) if when is None else when)).drop("_key", "_hit")


def overlap_audit(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str) -> DataFrame:
    """For each key on both sides, how many ids of either hold it and the smallest of each."""
    left = a.groupBy(key).agg(F.count_distinct(a_id).alias("n_a"), F.min(a_id).alias("first_a"))
    right = b.groupBy(key).agg(F.count_distinct(b_id).alias("n_b"), F.min(b_id).alias("first_b"))
    return left.join(right, key)


def cross_split_groups(df: DataFrame, group: str) -> DataFrame:
    """Groups that lie in more than one split, with their splits."""
    return df.groupBy(group).agg(F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"), F.count("*").alias("n")).where("splits LIKE '%,%'")


def conflicting(df: DataFrame, content: str, label: str) -> DataFrame:
    """Contents with more than one label."""
    return df.groupBy(content).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("n")).where("labels > 1")


def bijection_audit(df: DataFrame, a: str, b: str) -> DataFrame:
    """Values of either side that map to several of the other."""
    def side(x, y, name):
        return df.groupBy(x).agg(F.count_distinct(y).alias("targets")).where("targets > 1").select(F.lit(name).alias("side"), F.col(x).cast("string").alias("value"), "targets")

    return side(a, b, f"{a}->{b}").unionByName(side(b, a, f"{b}->{a}"))


def quarantine_groups(df: DataFrame, group: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Rows of groups in one split, and rows of groups in several."""
    keyed = df.withColumn("_at", F.struct(group))  # so null is a group too
    n = stable(keyed.groupBy("_at").agg(F.count_distinct(split).alias("_n"), F.count("*").alias("_c")))
    marked = spread_join(keyed, n, "_at", "_c", n.agg(F.sum("_c")).first()[0] or 0).drop("_at")
    return marked.where("_n <= 1").drop("_n"), marked.where("_n > 1").drop("_n")


def keep_first(df: DataFrame, key: list[str], order: list, report: str | None = None) -> DataFrame:
    """First row of each key in ``order``; with ``report`` all rows, their place ``rn`` and the kept row's column as ``kept``.

    Without a report each task sends the first row of a key only (a window group limit), so a key with a third of all
    rows arrives as one row for each task. With one, places come from ranges of keys and order, and the kept row's column
    goes back to the rows of a hot key where they are. Null keys are a key.
    """
    if report is None:
        first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        return df.withColumn("rn", first).where("rn = 1").drop("rn")
    places = ranked(df, key, [F.col(c) if isinstance(c, str) else c for c in order], "rn").withColumn("rn", (F.col("rn") + 1).cast("int"))
    placed = stable(places.withColumn("_at", F.struct(*key)))
    side = stable(placed.groupBy("_at").agg(F.count("*").alias("_c"), F.max_by(report, -F.col("rn")).alias("kept")))
    return spread_join(placed, side, "_at", "_c", placed.count()).drop("_at")


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row: missing, extra and duplicated keys of ``actual`` against ``expected``."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(1))
    a = actual.groupBy(key).agg(F.count("*").alias("_a"))
    both = e.join(a, key, "full_outer")
    count = lambda c: F.count_if(c)
    return both.agg(count(F.col("_a").isNull()).alias("missing"), count(F.col("_e").isNull()).alias("extra"), count(F.col("_a") > 1).alias("duplicated"))


def collapse(df: DataFrame, content: str, label: str, order: list) -> DataFrame:
    """Exact duplicates collapse to their first row; contents with conflicting labels go altogether."""
    keyed = df.withColumn("_at", F.struct(content))  # so null is a content too
    labels = stable(keyed.groupBy("_at").agg(F.count_distinct(label).alias("_labels"), F.count("*").alias("_c")))
    agreed = spread_join(keyed, labels, "_at", "_c", labels.agg(F.sum("_c")).first()[0] or 0).where("_labels <= 1").drop("_labels", "_at")
    return keep_first(agreed, [content], order)


def keys_disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both; empty if the sets are disjoint."""
    return a.select(key).intersect(b.select(key))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, multiplicity counted, with the side's name."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def replace_subset(base: DataFrame, full: DataFrame, where: Column) -> DataFrame:
    """``base`` with the rows that meet ``where`` replaced by ``full``."""
    return base.where(~where).unionByName(full, allowMissingColumns=True)


def array_overlap(df: DataFrame, row: str, items: Column, protected: DataFrame, key: str) -> DataFrame:
    """Rows of which no array element is protected."""
    lost = df.select(row, F.explode(items).alias(key)).join(protected.select(key).distinct(), key, "left_semi").select(row).distinct()
    return df.join(lost, row, "left_anti")


def united(parts: list[DataFrame], key: str) -> DataFrame:
    """All rows of several tables; the job fails where an id comes twice."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    twice = out.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").limit(1).agg(F.count("*").alias("_twice"))
    return out.crossJoin(F.broadcast(twice)).withColumn("_ok", F.assert_true(F.col("_twice") == 0, "an id comes twice")).where("_ok IS NULL").drop("_ok", "_twice")  # one row
