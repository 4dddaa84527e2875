"""Array functions for scores, options and boxes; higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp((x - top) / temperature))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def argmax(z: Column) -> Column:
    """Zero-based place of the largest value; the first of equals."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def entropy_confidence(p: Column) -> Column:
    """1 - H/ln K, clipped to [0, 1]; one option is certain."""
    h = F.aggregate(p, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return F.when(F.size(p) > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - h / F.ln(F.size(p))))).otherwise(F.lit(1.0))


def expectation(p: Column) -> Column:
    """Expected level: sum of i * p_i."""
    return total(F.transform(p, lambda x, i: x * i))


def brier(p: Column, target: Column) -> Column:
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == target, 1.0).otherwise(0.0), F.lit(2.0))))


def log_loss(p: Column, target: Column, clip: float = 1e-12) -> Column:
    return -F.ln(F.greatest(F.element_at(p, target + 1), F.lit(clip)))


def ranked_probability(p: Column, target: Column) -> Column:
    """Mean squared gap of the cumulative distributions over the first K - 1 levels."""
    gaps = F.transform(p, lambda x, i: F.pow(total(F.slice(p, F.lit(1), i + 1)) - F.when(i >= target, 1.0).otherwise(0.0), F.lit(2.0)))
    return F.try_divide(total(F.slice(gaps, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))), F.size(p) - 1)


def rotate(a: Column, k: Column) -> Column:
    """The array from place ``k`` (zero-based) on, then its start."""
    n = F.size(a)
    return F.when(n == 0, a).otherwise(F.concat(F.slice(a, k + 1, n), F.slice(a, F.lit(1), k)))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes given by l, t, w, h; 0 for empty boxes."""
    w = F.greatest(F.lit(0.0), F.least(a["l"] + a["w"], b["l"] + b["w"]) - F.greatest(a["l"], b["l"]))
    h = F.greatest(F.lit(0.0), F.least(a["t"] + a["h"], b["t"] + b["h"]) - F.greatest(a["t"], b["t"]))
    both = w * h
    return F.coalesce(F.try_divide(both, a["w"] * a["h"] + b["w"] * b["h"] - both), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
