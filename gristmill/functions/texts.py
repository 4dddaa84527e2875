"""Texts of labels and options: display forms, likeness of options, common prefixes, canonical JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the video source whose display form does not follow from their capitals.
DISPLAY = {"Shotput": "Shot Put", "Skijet": "Ski Jet", "YoYo": "Yo-Yo", "TaiChi": "Tai Chi", "Nunchucks": "Nunchucks"}


def display_label(label: Column, special: dict[str, str] | None = None) -> Column:
    """A camel-case label as words: a blank before each capital that follows a small letter or a digit."""
    fixed = F.create_map(*[F.lit(x) for kv in (DISPLAY if special is None else special).items() for x in kv])
    return F.coalesce(fixed[label], F.regexp_replace(label, r"(?<=[a-z0-9])(?=[A-Z])", " "))


def likeness(options: Column) -> Column:
    """Largest Jaccard similarity of the words of two options, and 0.01 for each option up to ten: how hard a question is.

    Options are few (a question has 255 at most), so all of its pairs are met inside the row.
    """
    words = F.transform(options, lambda o: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(o, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))))
    shared = F.transform(words, lambda a, i: F.array_max(F.transform(F.slice(words, i + 2, F.greatest(F.size(words), F.lit(1))), lambda b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))))
    return F.coalesce(F.array_max(shared), F.lit(0.0)) + F.least(F.size(options), F.lit(10)) * 0.01


def common_prefix(arrays: Column) -> Column:
    """How many leading elements all arrays of an array share."""
    first, least = F.get(arrays, F.lit(0)), F.coalesce(F.array_min(F.transform(arrays, lambda a: F.size(a))), F.lit(0))
    odd = F.filter(F.transform(F.slice(first, F.lit(1), least), lambda x, i: F.when(F.forall(arrays, lambda a: F.get(a, i).eqNullSafe(x)), None).otherwise(i)), lambda i: i.isNotNull())
    return F.when(least > 0, F.coalesce(F.get(odd, F.lit(0)), least)).otherwise(0)


def softcap(x: Column, cap: float) -> Column:
    """Values squeezed into (-cap, cap) by the hyperbolic tangent."""
    return F.lit(cap) * F.tanh(x / F.lit(cap))


def canonical_text(value: Column) -> Column:
    """One text for equal JSON values: a string as it is, all else with sorted keys and single spaces after marks."""

    @F.pandas_udf("string")
    def sort(values: pd.Series) -> pd.Series:  # the order of keys of nested objects is beyond built-in functions
        def one(value):
            found = None if value is None else json.loads(value)
            return found if found is None or isinstance(found, str) else json.dumps(found, ensure_ascii=False, sort_keys=True)

        return pd.Series([one(v) for v in values], dtype=object)

    return sort(value)
