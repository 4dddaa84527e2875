"""Source divergence audit: which terms a source uses beyond its language, and how far apart sources are.

Terms are counted per group (language and source) in each task before anything is shuffled. From then on a row is a
posting, a term of a group with its count, partitioned by language and term, so neither a large source nor a frequent
term gathers in one task. Probabilities are whole numbers of 1e-9 with a prior of 5 for each kept term.

Term search: the postings of a group fall into buckets by count. A bucket's largest count and the least language
probability in it bound the excess of all its terms. Buckets are opened best bound first until they hold k terms; the
k-th excess found so far then closes every bucket whose bound is strictly below it, and the others are opened.

Pairs: a source's distance to another is the sum over all kept terms. Postings give the terms that both have; a term
that one of them lacks has the other's least probability, so sums over one source's postings give the rest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stable

#: Documents of its language that a kept term is in, and the prior of each kept term.
LEAST_DOCS, PRIOR, UNIT = 30, 5, 1_000_000_000
#: Different terms that a task counts before it hands them on; bytes of a text that are split at a time.
TERMS_HELD, SLICE = 200_000, 1 << 20
#: Sources of a language in one tile of pairs, kept terms of a language in one shard of a tile (about).
TILE, SHARD = 256, 2048
#: Bytes that make no part of a term become blanks, A-Z lower case; all others stay, so UTF-8 beyond ASCII does too.
_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _slices(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in lists that do not grow with it."""
    at = 0
    while at < len(raw):
        stop = len(raw) if len(raw) - at <= SLICE else raw.rfind(b" ", at, at + SLICE) + 1
        if stop <= at:  # one term beyond a slice
            stop = raw.find(b" ", at)
            stop = len(raw) if stop < 0 else stop
        yield raw[at:stop].split()
        at = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial ``lang, source, term, n, docs`` of rows ``lang, source, text``."""
    found: dict[tuple, tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, docs) in found.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                some = terms[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        found.clear()

    held = 0
    for batch in batches:
        for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            own: set[bytes] = set()
            for terms in _slices(raw.as_py().translate(_LETTERS)):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            held += len(n)
            if held >= TERMS_HELD:
                yield from rows()
                held = 0
    yield from rows()


@dataclass
class Audit:
    """Stored frames. ``groups``: ``lang, source, total`` (counts of kept terms), ``terms`` (kept ones it has), ``kept`` (of the
    language), ``floor`` (probability of a kept term without count). ``langs``: ``lang, all, kept``. ``postings``: ``lang,
    source, term, n, all_n`` (count in the group and in the language) of kept terms.
    """

    groups: DataFrame
    langs: DataFrame
    postings: DataFrame


def probability(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(1e9 * (count + 5) / (total + 5 * kept))``, exactly: products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    share = F.call_function("div", (wide(count) + F.lit(PRIOR)) * F.lit(UNIT), F.greatest(wide(total) + wide(kept) * F.lit(PRIOR), F.lit(1)))
    return F.lit(1).cast("long") + share.cast("long")


def count_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> Audit:
    """Counts the terms of all documents. Null text, lang and source count as ``''``; other columns are ignored.

    Repeated rows each count. A group exists if a row has it, with terms or without.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"), text.alias("text"))
    parts = slim.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # One shuffle serves the sums of a group's term, the term's sums over its groups, and their join.
    dealt = parts.repartition(shuffle_partitions(docs.sparkSession), "lang", "term")
    sums = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    kept = sums.withColumn("all_n", F.sum("n").over(over)).withColumn("all_docs", F.sum("docs").over(over)).where(F.col("all_docs") >= least_docs)
    postings = stable(kept.select("lang", "source", "term", "n", "all_n"))
    langs = stable(postings.select("lang", "term", "all_n").distinct().groupBy("lang").agg(F.sum("all_n").alias("all"), F.count("*").alias("kept")))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    groups = slim.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs.drop("all"), "lang", "left")
    groups = groups.select("lang", "source", zero("total").alias("total"), zero("terms").alias("terms"), zero("kept").alias("kept"))
    return Audit(stable(groups.withColumn("floor", probability(F.lit(0), F.col("total"), F.col("kept")))), langs, postings)


def excess_terms(audit: Audit, k: int = 50) -> DataFrame:
    """``lang, source, item, value, rank``: the k terms of each group with the largest ``p - q`` above 0, ties by term.

    ``p`` is the term's probability in the group, ``q`` in the language.
    """
    p = probability(F.col("n"), F.col("total"), F.col("kept"))
    q = probability(F.col("all_n"), F.col("all"), F.col("kept"))
    keys = ["lang", "source"]
    constants = audit.groups.select(*keys, "total", "kept").join(audit.langs.select("lang", "all"), "lang")
    # Counts below 16 have a bucket each, above there are four to an octave.
    bucket = F.when(F.col("n") < 16, F.col("n")).otherwise(F.floor(F.log2(F.col("n")) * 4)).cast("int")
    rows = audit.postings.withColumn("bucket", bucket)
    bounds = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("size"), F.max("n").alias("n"), F.min("all_n").alias("all_n")).join(constants, keys)
    bounds = bounds.withColumn("bound", p - q).where("bound > 0")
    ahead = Window.partitionBy(*keys).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = stable(bounds.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0))).select(*keys, "bucket", "bound", "ahead", "total", "all", "kept"))

    def opened(buckets: DataFrame) -> DataFrame:
        found = rows.join(buckets, [*keys, "bucket"]).withColumn("value", p - q).where("value > 0")
        best = Window.partitionBy(*keys).orderBy(F.desc("value"), "term")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*keys, F.col("term").alias("item"), "value", "rank")

    first = stable(opened(bounds.where(F.col("ahead") < k)))
    kth = first.where(F.col("rank") == k).select(*keys, F.col("value").alias("kth"))
    rest = bounds.where(F.col("ahead") >= k).join(kth, keys, "left").where(F.col("bound") >= F.coalesce("kth", F.lit(1))).drop("kth")
    both = first.drop("rank").unionByName(opened(rest).drop("rank"))
    last = Window.partitionBy(*keys).orderBy(F.desc("value"), "item")
    return both.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)


def _tile(own: pd.DataFrame, groups: pd.DataFrame) -> np.ndarray:
    """For groups i and j: what the terms of ``own`` add to a sum of |p_i - p_j| that takes every term for one that both lack."""
    index = pd.MultiIndex.from_frame(groups[["tile", "source"]])
    group = index.get_indexer(pd.MultiIndex.from_frame(own[["tile", "source"]]))
    term, p = pd.factorize(own["term"])[0], own["p"].to_numpy(np.int64)
    floor, n = groups["floor"].to_numpy(np.int64), len(groups)
    out = np.zeros((n, n), dtype=np.int64)
    by_term = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[by_term], np.arange(term.max() + 2 if len(term) else 1))
    by_group = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[by_group], np.arange(n + 1))
    one_sided = np.zeros((n, n), dtype=np.int64)
    for i in range(n):
        mine = by_group[edges[i] : edges[i + 1]]
        if not len(mine):
            continue
        values = np.sort(p[mine])
        sums = np.r_[0, np.cumsum(values)]
        below = np.searchsorted(values, floor)
        one_sided[i] = (sums[-1] - 2 * sums[below]) - floor * (len(values) - 2 * below)
        lengths = starts[term[mine] + 1] - starts[term[mine]]
        first = np.repeat(starts[term[mine]] - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
        met = by_term[first + np.arange(lengths.sum())]
        a, b, other = np.repeat(p[mine], lengths), p[met], group[met]
        # Terms of both are in the sums of either side, and are taken for terms of neither in the last one.
        shared = np.abs(a - b) - np.abs(a - floor[other]) - np.abs(floor[i] - b) + np.abs(floor[i] - floor[other])
        np.add.at(out[i], other, shared)
    return out + one_sided + one_sided.T


def distances(audit: Audit, tile: int = TILE, shard: int = SHARD) -> DataFrame:
    """``lang, source, item, value``: for each group and each other source of its language the sum of |p - q| over kept terms.

    Sources are dealt into tiles by hash, kept terms into shards; a task takes the postings of two tiles in one shard, so it
    holds about ``2 * tile * shard`` postings however large the groups are, and gives one row for each pair.
    """
    sizes = audit.groups.groupBy("lang").agg(F.count("*").alias("groups"), F.max("kept").alias("kept"))
    sizes = sizes.select("lang", F.ceil(F.col("groups") / tile).cast("int").alias("tiles"), F.greatest(F.ceil(F.col("kept") / shard), F.lit(1)).cast("int").alias("shards"))
    placed = stable(audit.groups.join(sizes, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")))
    pairs = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    halves = lambda df: df.withColumn("_other", pairs).withColumn("low", F.least("tile", "_other")).withColumn("high", F.greatest("tile", "_other")).drop("_other")
    everywhere = halves(placed).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("lang", "low", "high", "shard", "tile", "source", "floor", "terms", "kept")
    everywhere = everywhere.toDF(*everywhere.columns)  # columns of its own beside those of the postings
    own = audit.postings.join(placed.select("lang", "source", "total", "kept", "tile", "tiles", "shards"), ["lang", "source"])
    own = halves(own.withColumn("p", probability(F.col("n"), F.col("total"), F.col("kept")))).withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))

    def one(key, postings: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        lang, low, high, at = key
        groups = groups.sort_values(["tile", "source"], ignore_index=True)
        found = _tile(postings, groups)
        if at == 0:  # once for all shards
            floor, terms, kept = (groups[c].to_numpy(np.int64) for c in ("floor", "terms", "kept"))
            found += (kept[:, None] - terms[:, None] - terms[None, :]) * np.abs(floor[:, None] - floor[None, :])
        i, j = np.nonzero(~np.eye(len(groups), dtype=bool))
        tiles = groups["tile"].to_numpy()
        wanted = (np.minimum(tiles[i], tiles[j]) == low) & (np.maximum(tiles[i], tiles[j]) == high)
        i, j = i[wanted], j[wanted]
        names = groups["source"].to_numpy()
        return pd.DataFrame({"lang": lang, "source": names[i], "item": names[j], "value": found[i, j]})

    keys = ["lang", "low", "high", "shard"]
    met = own.select(*keys, "tile", "source", "term", "p").groupBy(*keys).cogroup(everywhere.groupBy(*keys)).applyInPandas(one, "lang string, source string, item string, value long")
    return met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_report(docs: DataFrame, k: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` with all distances, part ``term`` with the k largest excesses.

    An empty table gives no rows, a language of one source no pairs, a language without kept terms pairs of value 0.
    """
    audit = count_terms(docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = distances(audit).withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(excess_terms(audit, k), "term"))
