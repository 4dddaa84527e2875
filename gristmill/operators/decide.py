"""Typed answers from option scores: a scorer, its stub, and corrections of the scores."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.hashing import synthetic_score
from gristmill.functions.vectors import argmax, entropy_confidence, expectation, softmax

from .typed import option_keys


def stub_scores(row: Column | str, keys: Column, salt: str = "") -> Column:
    """Hash-derived logits, one for each key."""
    row = (F.col(row) if isinstance(row, str) else row).cast("string")
    return F.transform(keys, lambda k: synthetic_score(F.lit(salt), row, k))


def answers(df: DataFrame, kind: str, keys: str, p: str) -> DataFrame:
    """Adds ``answer`` and ``confidence``: key of the likeliest option, P(true) or the expected level as text."""
    top = F.element_at(F.col(keys), F.array_position(p, F.array_max(p)).cast("int"))
    value = F.when(F.col(kind) == "noul", F.element_at(p, 2)).when(F.col(kind) == "score", expectation(F.col(p)))
    return df.withColumns({"choice": F.when(F.col(kind) == "choice", top), "value": F.round(value, 6), "confidence": F.round(entropy_confidence(F.col(p)), 6)})


def evaluate(requests: DataFrame, scorer: Callable[[str, str, list[str]], list[float]], least: int = 2, most: int = 255) -> DataFrame:
    """``id, name, choice, value, confidence, probabilities`` of typed requests.

    ``requests``: id, state, name, kind, instructions, options (array of key and text). Each scorer call sees
    one question, in Arrow batches; it returns non-negative weights of the options, which are normalised.
    Options without text stand for their key. Questions outside the limits fail the job.
    """

    @F.pandas_udf("array<double>")
    def run(state: pd.Series, instructions: pd.Series, options: pd.Series) -> pd.Series:
        def one(s, q, o):
            w = [float(x) for x in scorer(s, q, list(o))]
            t = sum(w)
            if len(w) != len(o) or not t > 0 or not all(math.isfinite(x) and x >= 0 for x in w):
                raise ValueError("the scorer must return one finite weight for each option")
            return [x / t for x in w]

        return pd.Series([one(*x) for x in zip(state, instructions, options)])

    n = F.size("options")
    fits = F.when(F.col("kind") == "noul", F.lit(True)).otherwise(n.between(least, F.when(F.col("kind") == "score", 10).otherwise(most)))
    checked = requests.withColumn("_ok", F.assert_true(fits, "a question has too few or too many options")).where("_ok IS NULL")
    texts = F.when(F.col("kind") == "noul", F.array(F.lit("false"), F.lit("true"))).otherwise(F.transform("options", lambda o: F.coalesce(o["text"], o["key"])))
    keyed = checked.withColumn("_keys", option_keys(F.col("kind"), F.col("options"))).withColumn("probabilities", run("state", "instructions", texts))
    return answers(keyed, "kind", "_keys", "probabilities").select("id", "name", "kind", "choice", "value", "confidence", "probabilities")


def minus_prior(df: DataFrame, z: str, prior: str, weights: list[float]) -> DataFrame:
    """One row for each weight: ``p`` with the prior's logits subtracted at that weight and renormalised, and ``pick``.

    The pick is the first largest of the logits: some that differ in the last digit have equal exponentials.
    """
    out = df.withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    less = out.withColumn("_less", F.zip_with(z, prior, lambda a, b: a - F.col("weight") * b))
    return less.withColumn("pick", argmax(F.col("_less"))).withColumn("p", softmax(F.col("_less"))).drop("_less")


def order_balanced(long: DataFrame, row: list[str], key: str, score: str) -> DataFrame:
    """Mean score of each key over all option orders, and its softmax within the row."""
    mean = long.groupBy(*row, key).agg(F.avg(score).alias("mean"))
    gathered = mean.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), "mean"))).alias("o"))  # a row's options only
    p = gathered.withColumn("p", softmax(F.transform("o", lambda s: s["mean"])))
    return p.select(*row, F.posexplode("o").alias("i", "s"), "p").select(*row, F.col("s.key").alias(key), F.round("s.mean", 6).alias("mean"), F.round(F.element_at("p", F.col("i") + 1), 6).alias("p"))


def agreement(a: DataFrame, b: DataFrame, row: str, p: str = "p") -> DataFrame:
    """One row: how many answers agree and the largest probability gap of two runs."""
    both = a.select(row, F.col(p).alias("_x")).join(b.select(row, F.col(p).alias("_y")), row)
    gap = F.array_max(F.zip_with("_x", "_y", lambda x, y: F.abs(x - y)))
    same = F.array_position("_x", F.array_max("_x")) == F.array_position("_y", F.array_max("_y"))
    return both.agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.round(F.max(gap), 6).alias("largest_gap"))
