"""Gates over reviews, media records and features, and views of one row for ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validation import first_reason


def review_status(rows: DataFrame, reviews: DataFrame, key: str, gold: str, options: Column, frame_policy: str) -> DataFrame:
    """Rows with ``status``: approved, or the first thing that their review lacks.

    ``reviews``: key, review_status, reviewer, visible, frame_policy, media_sha256, gold_key. The row's hash is
    ``media_sha256`` too. Of several reviews of a row one that is wrong counts, so none may be.
    """
    theirs = reviews.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in ("review_status", "reviewer", "visible", "frame_policy", "media_sha256", "gold_key")])
    both = rows.join(theirs, key, "left")
    off = lambda c: F.coalesce(~c, F.lit(True))
    why = first_reason([(F.col("_review_status").isNull(), "unreviewed"), (off(F.col("_review_status") == "approved"), "not_approved"), (off(F.trim("_reviewer") != ""), "no_reviewer"), (off(F.col("_visible")), "not_visible"), (off(F.col("_frame_policy") == frame_policy), "frame_policy"), (off(F.col("_media_sha256") == F.col("media_sha256")), "other_media"), (off(F.array_contains(options, F.col("_gold_key"))), "gold_key"), (off(F.col("_gold_key") == F.col(gold)), "other_gold")])
    judged = both.withColumn("_why", why).groupBy(key).agg(F.min(F.when(F.col("_why").isNotNull(), F.col("_why"))).alias("_bad"))
    return rows.join(judged, key).withColumn("status", F.coalesce("_bad", F.lit("approved"))).drop("_bad")


def verify_media(rows: DataFrame, records: DataFrame, key: str, source: str) -> DataFrame:
    """Rows with ``status`` of their materialised record: ready, missing, other_source or other_hash."""
    theirs = records.select(key, F.col(source).alias("_source"), F.col("sha256").alias("_sha256"), F.lit(True).alias("_there"))
    both = rows.join(theirs, key, "left")
    why = first_reason([(F.col("_there").isNull(), "missing"), (~F.col("_source").eqNullSafe(F.col(source)), "other_source"), (~F.col("_sha256").eqNullSafe(F.col("sha256")), "other_hash")])
    return both.withColumn("status", F.coalesce(why, F.lit("ready"))).drop("_source", "_sha256", "_there")


def metadata_mismatches(features: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys on both sides of which a column differs, and the columns that do."""
    both = features.select(key, *[F.col(c).alias(f"_f_{c}") for c in columns]).join(rows.select(key, *columns), key)
    wrong = F.filter(F.array(*[F.when(~F.col(f"_f_{c}").eqNullSafe(F.col(c)), c) for c in columns]), lambda x: x.isNotNull())
    return both.select(key, F.array_join(wrong, ",").alias("columns")).where("columns <> ''")


def views(df: DataFrame, variants: dict[str, dict[str, Column]]) -> DataFrame:
    """One row for each named view; a view replaces some columns, such as the state or the media by null."""
    names = list(dict.fromkeys(c for v in variants.values() for c in v))
    out = df.withColumn("view", F.explode(F.array(*map(F.lit, variants))))
    for c in names:
        value = F.col(c)
        for name, changed in variants.items():
            if c in changed:
                value = F.when(F.col("view") == name, changed[c].cast(df.schema[c].dataType)).otherwise(value)
        out = out.withColumn(c, value)
    return out


def lexical(text: Column, required: list[str], excluded: list[str]) -> Column:
    """Some required and no excluded word, as whole words in any case."""
    words = lambda xs: r"(?i)\b(" + "|".join(xs) + r")\b"
    return F.coalesce(text.rlike(words(required)) & ~text.rlike(words(excluded)), F.lit(False))


def placeholder_splits(df: DataFrame, split: str, label: str, placeholder) -> DataFrame:
    """Splits all of whose labels are the placeholder."""
    return df.groupBy(split).agg(F.count("*").alias("n"), F.bool_and(F.col(label).eqNullSafe(F.lit(placeholder))).alias("only")).where("only").select(split, "n")


def numeric_order(names: Column) -> Column:
    """Names by the number before their extension, then by name; names without one come last."""
    keyed = F.transform(names, lambda n: F.struct(F.coalesce(F.regexp_extract(n, r"(\d+)(?:\.\w+)?$", 1).try_cast("long"), F.lit(2**62)).alias("k"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda s: s["n"])


def top_scores(scores: Column, k: int) -> Column:
    """``i, score`` of the k largest, largest first, ties by place."""
    keyed = F.transform(scores, lambda s, i: F.struct((-s).alias("m"), i.alias("i"), s.alias("score")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: F.struct(s["i"].alias("i"), s["score"].alias("score")))


def answer_labels(candidates: Column, most: int = 255) -> Column:
    """The first ``most`` distinct labels, in order, without surrounding blanks or blank ones."""
    return F.slice(F.array_distinct(F.filter(F.transform(candidates, lambda c: F.trim(c)), lambda c: c != "")), 1, most)


def select_candidate(df: DataFrame, guard: Column, order: list[Column]) -> DataFrame:
    """The one row that the guard prefers, then the order: one partial top-1, no full sort."""
    return df.withColumn("_g", F.when(guard, 0).otherwise(1)).orderBy("_g", *order).limit(1).drop("_g")


def view_counts(df: DataFrame, view: str, head: str, correct: str) -> DataFrame:
    """Rows and correct ones of each view and head, and those that a head gets right in every view of a row's group."""
    return df.groupBy(view, head).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("correct"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"))


def weight_problems(weights: DataFrame, name: str, values: str, reported: DataFrame | None = None) -> DataFrame:
    """Tensors with a value that is not finite, none at all, or another size than a report says; with the reason."""
    odd = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rules = [(F.coalesce(F.size(values) < 1, F.lit(True)), "empty"), (odd, "not_finite")]
    if reported is not None:
        weights = weights.join(reported.select(name, F.col("size").alias("_size")), name, "full_outer")
        rules = [(F.col(values).isNull(), "missing"), (F.col("_size").isNull(), "not_reported"), *rules, (F.size(values) != F.col("_size"), "other_size")]
    return weights.select(name, first_reason(rules).alias("reason")).where("reason IS NOT NULL")


def one_token_labels(candidates: Column, tokens: Column, most: int = 255) -> Column:
    """The first ``most`` distinct labels that are one token; ``tokens`` are the numbers of tokens of the candidates."""
    kept = F.transform(F.filter(F.arrays_zip(candidates.alias("c"), tokens.alias("t")), lambda z: z["t"] == 1), lambda z: z["c"])
    return answer_labels(kept, most)
