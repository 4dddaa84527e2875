"""Reasons for rejection as columns, and gates over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds; null if none does. A null condition does not hold."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def options_reason(options: Column, least: int = 2, most: int = 10) -> Column:
    texts = F.transform(options, lambda o: F.lower(F.trim(F.coalesce(o, F.lit("")))))
    return first_reason([(options.isNull() | (F.size(options) < least), "too_few_options"), (F.size(options) > most, "too_many_options"), (F.exists(texts, lambda t: t == ""), "blank_option"), (F.size(F.array_distinct(texts)) < F.size(texts), "duplicate_option")])


def split_by_reason(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and quarantined rows with their reason."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def invariant_violations(rows: DataFrame) -> DataFrame:
    """Rules that decision rows break, with how many rows; empty for a sound table."""
    keys = F.transform("question.options", lambda o: o["key"])
    n = F.size("question.options")
    checks = {
        "gold_not_option": ~F.coalesce(F.array_contains(keys, F.col("gold.key")), F.lit(False)),
        "media_on_text": (F.col("modality") == "text") & F.col("media").isNotNull(),
        "media_missing": (F.col("modality") != "text") & F.col("media").isNull(),
        "option_count": ~F.coalesce(n.between(2, 255), F.lit(False)),
    }
    row = rows.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    ids = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_id"))
    groups = rows.groupBy("source.repo", "source.group").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("group_in_splits"))
    wide = row.crossJoin(ids).crossJoin(groups)  # one row each
    names = [*checks, "duplicate_id", "group_in_splits"]
    return wide.unpivot([], names, "rule", "n").where("n > 0")


def prediction_problems(options: Column, scores: Column) -> Column:
    """Why a prediction does not fit its question: keys of a map of scores against option keys, and finiteness."""
    keys = F.map_keys(scores)
    odd = F.exists(F.map_values(scores), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return first_reason([(scores.isNull(), "missing"), (F.size(F.array_except(options, keys)) > 0, "missing_key"), (F.size(F.array_except(keys, options)) > 0, "extra_key"), (odd, "not_finite")])


def probabilities_reason(p: Column, n: Column, eps: float = 1e-3) -> Column:
    s = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    return first_reason([(p.isNull() | (F.size(p) != n), "wrong_size"), (F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)), "out_of_range"), (F.abs(s - 1) > eps, "sum_not_one")])


def gate(df: DataFrame, message: str, condition: Column) -> DataFrame:
    """A one-row table that fails the job where ``condition`` over its aggregates does not hold."""
    return df.select("*", F.assert_true(condition, message).alias("_gate")).where("_gate IS NULL").drop("_gate")


def inside(box: dict[str, Column], width: Column, height: Column) -> Column:
    """A box of positive size within a screen."""
    return (box["w"] > 0) & (box["h"] > 0) & (box["l"] >= 0) & (box["t"] >= 0) & (box["l"] + box["w"] <= width) & (box["t"] + box["h"] <= height)


def safe_path(path: Column) -> Column:
    """Relative, without drive, backslash or a parent step."""
    return ~(path.isNull() | (path == "") | path.startswith("/") | path.contains("\\") | path.rlike(r"(^|/)\.\.(/|$)") | path.rlike(r"^[A-Za-z]:"))


def single_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The match of a pattern that occurs exactly once; else null."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def eligibility(kind: Column, options: Column, tokens: Column, modality: Column, assets: Column, present: Column, budget: int = 1400, most_options: int = 26, most_assets: int = 8) -> Column:
    """Why a question cannot be used, else null: number of options, token budget, number, kind and presence of media,
    options of a choice that are not two different ones. ``assets``: kinds of the media; ``present``: all files exist."""
    n = F.coalesce(F.size(assets), F.lit(0))
    texts = F.transform(options, lambda o: F.lower(F.trim(F.coalesce(o, F.lit("")))))
    return first_reason([
        (~F.coalesce(F.size(options).between(2, most_options), F.lit(False)), "candidate_count"),
        (F.coalesce(tokens > budget, F.lit(True)), "text_token_budget"),
        ((modality != "text") & ~n.between(1, most_assets), "unsupported_media_count"),
        ((n > 0) & ~F.coalesce(present, F.lit(False)), "missing_media"),
        ((n > 0) & F.exists(assets, lambda k: ~k.isin("image", "video")), "unsupported_media_kind"),
        ((kind == "choice") & (F.size(F.array_distinct(texts)) < 2), "invalid_candidates"),
    ])


def media_reason(size: Column, width: Column, height: Column, seconds: Column, least: int = 32, most: int = 8192, most_bytes: int = 20_000_000) -> Column:
    """Why a media record is invalid, else null: bytes, sides in pixels where they are known, and a duration of videos.

    The measures come from a decoder; this is the rule on them."""
    side = lambda c: c.isNotNull() & ~c.between(least, most)
    return first_reason([(~F.coalesce(size.between(1, most_bytes), F.lit(False)), "bytes"), (side(width) | side(height), "dimensions"), (seconds.isNotNull() & ~(seconds > 0), "duration")])


def media_kind(path: Column) -> Column:
    """Image, video or audio by the extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    return F.when(ext.isin("jpg", "jpeg", "png", "webp", "gif", "bmp"), "image").when(ext.isin("mp4", "mkv", "webm", "avi", "mov"), "video").when(ext.isin("wav", "mp3", "flac"), "audio")


def selection_gate(df: DataFrame, split: str, family: str, key: str, least: dict[str, int], families: list[str]) -> DataFrame:
    """One row: number of rows, and an order-free fingerprint of the selection; the job fails where a split is short of
    its minimum or lacks a family."""
    h = F.xxhash64(F.col(key).cast("string"))
    row = df.agg(*[F.count_if(F.col(split) == s).alias(f"_{s}") for s in least], F.collect_set(family).alias("_families"), F.count("*").alias("n"), F.bit_xor(h).alias("fingerprint"))
    ok = F.forall(F.array(*map(F.lit, families)), lambda f: F.array_contains("_families", f))
    for s, n in least.items():
        ok = ok & (F.col(f"_{s}") >= n)
    return gate(row, "the selection is too small", ok).select("n", "fingerprint")


def declared(catalog: DataFrame, licences: list[str], labels: DataFrame | None = None) -> DataFrame:
    """Sources (``repo, licence, label_map``) whose declared licence is none of ``licences``, or whose label map is not
    that of ``labels`` (``repo, label_map``); with the reason. Empty if all agree."""
    known = catalog if labels is None else catalog.join(labels.withColumnRenamed("label_map", "_map"), "repo", "left")
    rules = [(~F.coalesce(F.lower(F.trim("licence")).isin(*[x.lower() for x in licences]), F.lit(False)), "licence")]
    if labels is not None:
        rules.append((~F.col("label_map").eqNullSafe(F.col("_map")), "label_map"))
    return known.withColumn("reason", first_reason(rules)).where("reason IS NOT NULL").select("repo", "reason")


def visible(target: dict[str, Column], negatives: Column, width: Column, height: Column, share: float = 0.2) -> Column:
    """Whether a target's centre lies in the screen and no negative (struct with w and h) covers more than ``share`` of it."""
    x, y = target["l"] + target["w"] / 2, target["t"] + target["h"] / 2
    large = F.exists(negatives, lambda n: n["w"] * n["h"] > F.lit(share) * width * height)
    return F.coalesce((x >= 0) & (y >= 0) & (x <= width) & (y <= height) & ~large, F.lit(False))
