"""Accuracy, loss, calibration and paired-uncertainty reports over long prediction tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.vectors import argmax, brier, expectation, log_loss, ranked_probability, softmax
from gristmill.lineage import stable
from gristmill.operators.skew import spread_join

# Fixed values, which results must match: least probability in a loss, normal quantile of an interval, temperatures tried.
CLIP, Z95 = 1e-12, 1.96
GRID_POINTS, GRID_LOW, GRID_HIGH = 161, 0.25, 4.0


def scored(df: DataFrame, z: str, target: str, temperature: float = 1.0, clip: float = CLIP) -> DataFrame:
    """Adds ``p, pick, correct, confidence, loss, brier`` to rows of logits and a zero-based target."""
    out = df.withColumn("p", softmax(F.col(z), temperature))
    t = F.col(target).cast("int")
    return out.withColumns({"pick": argmax(F.col(z)), "confidence": F.array_max("p"), "loss": log_loss(F.col("p"), t, clip), "brier": brier(F.col("p"), t)}).withColumn("correct", (F.col("pick") == t).cast("int"))


def base_metrics() -> list[Column]:
    return [F.count("*").alias("n"), F.sum("correct").cast("long").alias("correct"), F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.avg("loss"), 6).alias("log_loss"), F.round(F.avg("brier"), 6).alias("brier")]


def grouping_sets(df: DataFrame, sets: list[list[str]], aggs: list[Column], columns: list[str] | None = None) -> DataFrame:
    """Each row counted once in every grouping set, in one expand and one shuffle.

    Columns outside a set are null; ``grouping_id`` tells the sets apart, with its bits in the order of ``columns``.
    """
    names = columns or list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    return out.agg(F.grouping_id(*names).cast("int").alias("grouping_id"), *aggs)


def macro(df: DataFrame, group: str, by: list[str] | None = None, value: str = "correct") -> DataFrame:
    """Mean of group means."""
    inner = df.groupBy(*(by or []), group).agg(F.avg(value).alias("_m"))
    return inner.groupBy(*(by or [])).agg(F.round(F.avg("_m"), 6).alias("macro"), F.count("*").alias("groups"))


def ordinal(df: DataFrame, p: str, target: str) -> DataFrame:
    """Mean absolute error of the expected level and ranked probability score."""
    t = F.col(target).cast("int")
    return df.agg(F.round(F.avg(F.abs(expectation(F.col(p)) - t)), 6).alias("mae"), F.round(F.avg(ranked_probability(F.col(p), t)), 6).alias("rps"))


def reliability(df: DataFrame, by: list[str], bins: int, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """Equal-width bins of the confidence, the last closed; empty bins are left out."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins).cast("int")).alias("bin")
    return df.groupBy(*by, b).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 6).alias("mean_confidence"), F.round(F.avg(correct), 6).alias("accuracy"))


def ece(df: DataFrame, by: list[str], bins: int = 10, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    b = F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins).cast("int")).alias("_b")
    inner = df.groupBy(*by, b).agg(F.count("*").alias("_n"), F.avg(confidence).alias("_c"), F.avg(correct).alias("_a"))
    return inner.groupBy(*by).agg(F.round(F.sum(F.col("_n") * F.abs(F.col("_a") - F.col("_c"))) / F.sum("_n"), 6).alias("ece"))


def wilson(n: Column, k: Column, z: float = Z95) -> tuple[Column, Column]:
    p = F.try_divide(k, n)
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / scale, (mid + half) / scale


#: Rows of a group up to which a percentile may hold all its values in one task.
HELD_VALUES = 100_000


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], held: int = HELD_VALUES) -> DataFrame:
    """``by``, ``n`` and exact interpolated percentiles by name, to six places; nulls do not count.

    Groups of at most ``held`` values are done by one aggregate. For a larger one a sketch brackets each percentile
    between two values; how many rows lie below and how often each value inside occurs is counted exactly, and only the
    bracket's values are put in order: some 6 in ``held`` of a group, so no task holds a group.
    """
    number = F.col(value).cast("double")
    rows = df.select(F.struct(*by).alias("_key"), number.alias("_v"), *by)
    brackets = [F.percentile_approx("_v", [max(p - 3 / held, 0.0), min(p + 3 / held, 1.0)], held).alias(f"_b{i}") for i, p in enumerate(shares.values())]
    counts = stable(rows.groupBy("_key").agg(F.count("_v").alias("n"), F.count("*").alias("_rows"), *brackets))
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    out = lambda cols: [F.col(f"_key.{b}").alias(b) for b in by] + ["n", *cols]
    large = counts.where(F.col("n") > held)
    if large.isEmpty():
        exact = [F.round(F.percentile("_v", F.lit(p)), 6).alias(name) for name, p in shares.items()]
        return rows.groupBy("_key").agg(F.count("_v").alias("n"), *exact).select(out(shares))
    within = spread_join(rows.select("_key", "_v"), counts, "_key", "_rows", total)
    small = within.where(F.col("n") <= held).groupBy("_key").agg(F.count("_v").alias("n"), *[F.round(F.percentile("_v", F.lit(p)), 6).alias(name) for name, p in shares.items()])
    parts = within.where(F.col("n") > held)
    below = parts.groupBy("_key").agg(*[F.count_if(F.col("_v") < F.col(f"_b{i}")[0]).alias(f"_below{i}") for i in range(len(shares))])
    held_by = [F.struct(F.lit(i).alias("i"), F.col("_v").between(F.col(f"_b{i}")[0], F.col(f"_b{i}")[1]).alias("in")) for i in range(len(shares))]
    inside = parts.select("_key", "_v", F.explode(F.array(*held_by)).alias("_s")).where("_s.in")
    values = inside.groupBy("_key", "_s.i", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_key", "i").orderBy("_v"))
    runs = values.withColumn("_upto", upto).join(below.join(large.select("_key", "n"), "_key"), "_key")
    found = []
    for i, (name, p) in enumerate(shares.items()):
        at = (F.col("n") - 1) * F.lit(p)
        reach = F.when(F.col("i") == i, F.col(f"_below{i}") + F.col("_upto"))
        pick = lambda place, reach=reach: F.min(F.when(reach > place, F.col("_v")))  # noqa: E731  the value at a place counted from 0
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        found.append(F.round(low + (high - low) * F.max(at - F.floor(at)), 6).alias(name))
    return runs.groupBy("_key").agg(F.first("n").alias("n"), *found).select(out(shares)).unionByName(small.select(out(shares)))


def upper_median(value: str) -> Column:
    """Element n // 2 of the sorted values of a column, by counts of its different values."""
    return (-F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{value})")).cast("long")


def temperature_grid(points: int = GRID_POINTS, low: float = GRID_LOW, high: float = GRID_HIGH) -> Column:
    step = (high / low) ** (1 / (points - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) * F.pow(F.lit(step), i.cast("double")))


def fit_temperature(df: DataFrame, by: list[str], z: str, target: str, most: int, points: int = GRID_POINTS, clip: float = CLIP) -> DataFrame:
    """The first grid point of least mean negative log-likelihood, for each group; up to ``most`` options.

    The grid is expanded after all else and folded back by a partial aggregate, so the shuffle carries one
    row for each group and grid point from each task. The sum over options is written out, not a lambda, and
    so stays in generated code.
    """
    lean = df.select(*by, *[(F.get(z, F.lit(i)) - F.array_max(z)).alias(f"_z{i}") for i in range(most)], (F.element_at(z, F.col(target).cast("int") + 1) - F.array_max(z)).alias("_y"))
    g = lean.select("*", F.posexplode(temperature_grid(points)).alias("_i", "t"))
    whole = sum((F.coalesce(F.exp(F.col(f"_z{i}") / F.col("t")), F.lit(0.0)) for i in range(most)), F.lit(0.0))
    nll = F.least(F.ln(whole) - F.col("_y") / F.col("t"), -F.ln(F.lit(clip)))
    mean = g.groupBy(*by, "_i", "t").agg(F.round(F.avg(nll), 9).alias("nll"))
    best = mean.groupBy(*by).agg(F.min(F.struct("nll", "_i", "t")).alias("b"))
    return best.select(*by, F.round("b.t", 6).alias("temperature"), F.round("b.nll", 6).alias("nll"), F.col("b._i").isin(0, points - 1).alias("at_boundary"))


def paired(df: DataFrame, row: str, model: str, a: str, b: str, by: list[str], correct: str = "correct") -> DataFrame:
    """Rows of both models side by side without a self-join: one aggregate by row."""
    one = lambda m: F.max(F.when(F.col(model) == m, F.col(correct)))
    wide = df.where(F.col(model).isin(a, b)).groupBy(*by, row).agg(one(a).alias("a"), one(b).alias("b"))
    return wide.where("a IS NOT NULL AND b IS NOT NULL")


def paired_delta(wide: DataFrame, by: list[str]) -> DataFrame:
    return wide.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("delta"), F.count_if((F.col("b") == 1) & (F.col("a") == 0)).alias("gained"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("lost"))


#: Cumulative probabilities of a Poisson count of mean one.
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]


_CUTS = np.array([math.ceil(p * 2**32) for p in POISSON], dtype=np.uint32)


def poisson_counts(words: np.ndarray) -> np.ndarray:
    """How many of ``POISSON`` each word reaches as a share of 2**32; the last cuts are looked at for the few words that reach them."""
    out = (words >= _CUTS[0]).view(np.uint8)
    for cut in _CUTS[1:3]:
        out += (words >= cut).view(np.uint8)
    top = np.flatnonzero(words >= _CUTS[3])
    out[top] = np.searchsorted(_CUTS, words[top], side="right")
    return out


def cluster_bootstrap(wide: DataFrame, cluster: str, resamples: int = 2000, seed: str = "boot") -> DataFrame:
    """``i, mean``: the mean of b - a in resamples of whole clusters.

    Clusters are reduced to two numbers first. A resample takes each cluster a Poisson number of times, so clusters
    need no ranks and no task sees them all. The number for resamples ``8 j`` to ``8 j + 7`` comes from the eight words
    of the digest of ``seed:j:cluster``, as shares of 2**32, by the cumulative probabilities of ``POISSON``. A task
    draws for its clusters as a matrix and hands on one sum for each resample, so what is shuffled does not depend on
    the number of clusters.
    """
    per = wide.groupBy(cluster).agg(F.count("*").cast("double").alias("n"), F.sum(F.col("b") - F.col("a")).cast("double").alias("d"))
    words = -(-resamples // 8)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, steps = np.zeros((2, 8 * words)), [f"{seed}:{j}".encode() for j in range(words)]
        for batch in batches:
            names = [b"" if c is None else b":" + c.encode() for c in batch.column(0).to_pylist()]
            numbers = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)])
            for at in range(0, len(names), 256):
                some = names[at : at + 256]
                raw = b"".join(sha256(s + n).digest() for n in some for s in steps)
                counts = poisson_counts(np.frombuffer(raw, dtype=">u4").astype(np.uint32))
                sums += np.nan_to_num(numbers[:, at : at + 256]) @ counts.reshape(len(some), 8 * words).astype(np.float64)
        if sums[0].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(sums[0][:resamples]), pa.array(sums[1][:resamples])], ["i", "n", "d"])

    # Rows of few bytes and long work: left to itself, Spark unites partitions by bytes to about as many as there are cores.
    tasks = max(int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * wide.sparkSession.sparkContext.defaultParallelism)
    sums = per.repartition(tasks, cluster).select(F.col(cluster).cast("string"), "n", "d").mapInArrow(draw, "i long, n double, d double")
    return sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).select(F.col("i").cast("int").alias("i"), F.try_divide("d", "n").alias("mean"))


def order_interval(samples: DataFrame, value: str = "mean", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Bounds that are elements of the sorted samples: of 2,000 the ones at 50 and 1,949."""
    a = samples.agg(F.array_sort(F.collect_list(value)).alias("a"))  # one number for each resample
    n = F.size("a")
    at = lambda i: F.round(F.element_at("a", (i + 1).cast("int")), 6)
    return a.select(n.cast("long").alias("resamples"), at(F.floor(n * low)).alias("low"), at(F.ceil(n * high) - 1).alias("high"))


def interval(samples: DataFrame, value: str = "mean", low: float = 0.025, high: float = 0.975) -> DataFrame:
    return samples.agg(F.count("*").alias("resamples"), F.round(F.percentile(value, F.lit(low)), 6).alias("low"), F.round(F.percentile(value, F.lit(high)), 6).alias("high"))


def metrics_agree(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Keys on which two reports differ by more than the tolerance, or that one lacks; empty if they agree."""
    both = a.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(1).alias("_ina")).join(b.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(1).alias("_inb")), keys, "full_outer")
    off = F.col("_ina").isNull() | F.col("_inb").isNull()
    for v in values:
        off = off | F.coalesce(F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}")) > tolerance, ~F.col(f"_a_{v}").eqNullSafe(F.col(f"_b_{v}")))
    return both.where(off).select(*keys)


def gates(candidate: DataFrame, baseline: DataFrame, keys: list[str], value: str, slack: float) -> DataFrame:
    """Whether the candidate keeps each baseline value within ``slack``, and all of them."""
    both = baseline.select(*keys, F.col(value).alias("base")).join(candidate.select(*keys, F.col(value).alias("new")), keys, "left")
    return both.withColumn("passed", F.coalesce(F.col("new") >= F.col("base") - slack, F.lit(False)))


def expected_packs(df: DataFrame, shard: Column, size: int = 64) -> DataFrame:
    counts = df.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"))
    return counts.agg(F.sum(F.ceil(F.col("n") / size)).cast("long").alias("packs"), F.sum("n").cast("long").alias("rows"))
