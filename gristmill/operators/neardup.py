"""Near-duplicate codes by Hamming distance, and range look-ups of prefixes."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.lineage import stable

from .graph import connected_components
from .skew import spread_join


#: Differences within a radius up to which the codes that are near to one are listed instead of met in bands.
LISTED = 1024


def sign_code(values: Column, bits: int) -> Column:
    """Bit i is set where value i is positive; up to 63 bits."""
    flags = F.transform(F.slice(values, 1, bits), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(flags, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def near_codes(df: DataFrame, code: str, bits: int, radius: int) -> DataFrame:
    """``x, y`` (x < y) of all different codes within ``radius``, of ``bits`` bits each; exact.

    Where few differences are within the radius (210 for 2 of 20 bits), each code lists the larger codes that are near to
    it, and those that occur are kept: the work is a fixed number for each code, however full the codes are. Else codes
    meet in pigeonhole bands: of ``radius + 1`` bands of the code a pair within the radius shares one at least; a pair that shares several is
    taken in the first. Equal codes are one candidate, so copies do not multiply candidates.
    """
    codes = df.select(F.col(code).alias("c")).where("c IS NOT NULL").distinct()
    if sum(comb(bits, r) for r in range(1, radius + 1)) <= LISTED:
        flips = [sum(1 << i for i in some) for r in range(1, radius + 1) for some in combinations(range(bits), r)]
        listed = codes.select(F.col("c").alias("x"), F.explode(F.array(*[F.lit(m).cast("long") for m in flips])).alias("m"))
        larger = listed.select("x", F.col("x").bitwiseXOR(F.col("m")).alias("y")).where("y > x")
        return larger.join(codes.select(F.col("c").alias("y")), "y", "left_semi").select("x", "y")
    width = -(-bits // (radius + 1))
    band = lambda c, i: F.shiftright(c, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    keys = F.array(*[F.struct(F.lit(i).alias("i"), band(F.col("c"), i).alias("v")) for i in range(radius + 1)])
    bands = codes.select("c", F.explode(keys).alias("k")).select("c", "k.i", "k.v")
    x, y = bands.select(F.col("c").alias("x"), "i", "v"), bands.select(F.col("c").alias("y"), "i", "v")
    first = F.lit(True)
    for j in range(radius):
        first = first & ((F.col("i") <= j) | (band(F.col("x"), j) != band(F.col("y"), j)))
    return x.join(y, ["i", "v"]).where((F.col("x") < F.col("y")) & first & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius)).select("x", "y")


def hamming_pairs(df: DataFrame, row: str, code: str, bits: int, radius: int) -> DataFrame:
    """``a, b, distance`` of all pairs of rows within ``radius``, those of equal codes too.

    All pairs are asked for here, so a code that very many rows share gives the square of their number; ``components``
    needs one row for each of them.
    """
    rows = df.select(F.col(row).alias("r"), F.col(code).alias("c"))
    equal = rows.select(F.col("c").alias("x"), F.col("c").alias("y")).where("x IS NOT NULL").distinct()
    near = near_codes(df, code, bits, radius).unionByName(equal)
    both = near.join(rows.withColumnsRenamed({"r": "p", "c": "x"}), "x").join(rows.withColumnsRenamed({"r": "q", "c": "y"}), "y")
    both = both.where((F.col("x") != F.col("y")) | (F.col("p") < F.col("q")))
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).cast("int").alias("distance"))


def components(df: DataFrame, row: str, code: str, bits: int, radius: int) -> DataFrame:
    """``node, component`` of the rows that another one is near to: the smallest row of those that links connect.

    Codes are connected first; rows of one code are a star around the smallest of them, never pairs.
    """
    stars = stable(df.where(F.col(code).isNotNull()).groupBy(code).agg(F.min(row).alias("low"), F.count("*").alias("n")))
    low = stars.select(F.col(code).alias("c"), "low", "n")
    near = near_codes(df, code, bits, radius)
    edges = near.join(low.select(F.col("c").alias("x"), F.col("low").alias("a")), "x").join(low.select(F.col("c").alias("y"), F.col("low").alias("b")), "y").select("a", "b")
    joined = connected_components(edges.unionByName(low.where("n > 1").select(F.col("low").alias("a"), F.col("low").alias("b"))))
    named = stable(low.join(joined.withColumnRenamed("node", "low"), "low").select(F.col("c").alias(code), "component", "n"))
    rows = df.select(row, code)
    return spread_join(rows, named, code, "n", named.agg(F.sum("n")).first()[0] or 0).select(F.col(row).alias("node"), "component")


def prefix_join(names: DataFrame, name: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Names beside each of ``prefixes`` that they start with; the columns of both.

    A name is cut to each length that some prefix has, and what is left must equal the prefix: a join by the whole
    prefix, so names that share a long beginning do not meet prefixes that they lack. There are as many lengths as the
    longest prefix has characters at most. The rows of a prefix that very many names have stay where they are. The empty
    prefix fits all names; nulls fit none. ``prefixes`` should be distinct and are counted with the names first.
    """
    lengths = prefixes.where(F.col(prefix).isNotNull()).select(F.length(prefix).alias("_n")).distinct()
    keyed = names.join(F.broadcast(lengths), F.length(name) >= F.col("_n")).withColumn("_key", F.substring(F.col(name), F.lit(1), F.col("_n"))).drop("_n")
    counts = keyed.groupBy("_key").agg(F.count("*").alias("_c"))
    side = stable(prefixes.withColumn("_key", F.col(prefix)).join(counts, "_key"))
    return spread_join(keyed, side, "_key", "_c", side.agg(F.sum("_c")).first()[0] or 0).drop("_key")
