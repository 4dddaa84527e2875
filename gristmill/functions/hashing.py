"""Deterministic identity: digests, buckets and normalised text, all inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def digest(*parts: Column | str, sep: str = ":") -> Column:
    """Hex SHA-256 of the parts joined by ``sep``; a string argument names a column."""
    return F.sha2(F.concat_ws(sep, *[text(p) for p in parts]), 256)


def ident(*parts: Column | str, length: int = 24) -> Column:
    """A row id: the first hex digits of the digest."""
    return F.substring(digest(*parts), 1, length)


def hash8(hexed: Column) -> Column:
    """The first eight hex digits as a number."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")


def bucket(hexed: Column, n: int) -> Column:
    return F.pmod(hash8(hexed), F.lit(n)).cast("int")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it and in whatever branch it stands."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def full_mod(hexed: Column, n: int) -> Column:
    """The whole 256-bit digest (64 hex digits) modulo ``n``, by folding as many digits at a time as a long holds beside ``n``."""
    width = (63 - n.bit_length()) // 4
    kind = "int" if n <= 1 << 26 else "long"

    def folded(h: Column) -> Column:
        acc = F.lit(0).cast("long")
        for at in range(0, 64, width):
            some = min(width, 64 - at)
            acc = (acc * F.lit(16**some).cast("long") + F.conv(F.substring(h, at + 1, some), 16, 10).cast("long")) % F.lit(n).cast("long")
        return acc.cast(kind)

    return once(hexed, folded)


def normalised(c: Column | str, unicode: bool = False) -> Column:
    """Blanks collapsed to one space, trimmed, lower case; null stays null.

    ``unicode`` also takes Unicode blanks and the ASCII separators, and writes the sharp s as ss.
    """
    pattern = r"(?U)[\s\x1c-\x1f]+" if unicode else r"[ \t\n\x0b\f\r]+"
    low = F.lower(F.trim(F.regexp_replace(text(c), pattern, " ")))
    return F.replace(low, F.lit("ß"), F.lit("ss")) if unicode else low


def synthetic_score(*parts: Column | str) -> Column:
    """A stub scorer's logit in [0, 1]: the first four hex digits of a digest over 65535."""
    return F.conv(F.substring(digest(*parts, sep=""), 1, 4), 16, 10).cast("double") / 65535.0
