"""N-gram Jaccard join with Bayesian candidate pruning.

1. A document becomes the set of its word 5-grams (64-bit hashes). Documents with equal sets are one *class*,
   told by a digest of the set; everything after this step is between classes.
2. Candidates: pairs that share a band of MinHash values. With ``BANDS`` bands of ``ROWS`` values a pair at the
   threshold of 0.8 is missed with probability (1 - 0.8**6)**40 < 6e-6, and a more similar pair with less.
   To bring such pairs together without listing them, classes that share a band are linked to the smallest of
   the band, never to one another, and connected: a *cluster* holds every candidate of its members.
3. A cluster is dealt into blocks, by the number of its classes and by the size of their sets, and each pair of
   blocks is a task of its own, however large the cluster. A task compares only the pairs that share a band.
4. MinHash values of a second family are computed and compared in steps of ``STEP``. After each step a pair is
   dropped if the posterior probability that its Jaccard similarity reaches the threshold, given the matches so
   far and a uniform prior, is below ``TOLERANCE``; a class whose pairs are all dropped gets no more values. The
   rest is verified exactly on the hashed sets.
5. Tasks give counts of links and one tree of the linked classes, not pairs, so a group of thousands of near
   copies costs as many rows as it has members. ``pairs`` gives the pairs where they are wanted.

No join sends all rows of a hot band, cluster or class to one task (``spread_join``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.graph import connected_components
from gristmill.operators.skew import spread_join

from .common import fresh, shuffle_partitions, stable
from .line_dedup import text_mark

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 6
#: Values that pruning compares at most, and how many at a time.
VALUES, STEP = 128, 16
TOLERANCE = 1e-6
#: Classes of a block, until a cluster has ``BLOCKS`` of them; then blocks grow, to ``MOST`` classes or ``GRAMS`` hashes.
BLOCK, BLOCKS, MOST, GRAMS = 192, 32, 2048, 4_000_000

_MULT = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=8)
def _hashers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words of a UTF-8 text.

    Words are what blanks separate, in lower case. A shorter text is one run of all its words; a text
    without words has none.
    """
    w = text.decode().lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    n = max(1, len(h) - words + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(len(h) if len(h) < words else words))
        for i in range(min(words, len(h))):
            out = (out ^ (out >> np.uint64(29))) * _MULT + h[i : i + n]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def minhash(grams: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` MinHash values of a non-empty set; sets of any size in bounded memory."""
    a, b = _hashers(n, seed)
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 512):
            np.minimum(least, (grams[at : at + 512, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


@lru_cache(maxsize=8)
def fewest_matches(threshold: float, tolerance: float, values: int, step: int) -> tuple[tuple[int, int], ...]:
    """``(n, m)``: after ``n`` values a pair with fewer than ``m`` matches is dropped.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), and the probability of
    reaching t is that of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(step, values + 1, step):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


class Sets:
    """The sets of a block: their band keys, and MinHash values that are computed only as far as they are asked for."""

    def __init__(self, grams: list[np.ndarray], bands: np.ndarray):
        self.grams, self.bands, self.size = grams, bands, np.array([len(g) for g in grams], dtype=np.int64)
        self.values = np.zeros((len(grams), VALUES), dtype=np.uint32)
        self.known = np.zeros(len(grams), dtype=np.int64)

    def upto(self, which: np.ndarray, n: int) -> None:
        """Computes the values before ``n`` of the sets that are asked for."""
        for i in which[self.known[which] < n].tolist():
            for at in range(int(self.known[i]), n, STEP):
                self.values[i, at : at + STEP] = minhash(self.grams[i], STEP, 1000 + at)
            self.known[i] = n


def linked(a: Sets, b: Sets | None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Pairs that share a band and whose Jaccard similarity is at least ``threshold``; within ``a`` if ``b`` is None."""
    within, b = b is None, a if b is None else b
    alive = np.zeros((len(a.grams), len(b.grams)), dtype=bool)
    for i in range(a.bands.shape[1]):
        alive |= a.bands[:, i, None] == b.bands[None, :, i]
    alive &= np.minimum(a.size[:, None], b.size) >= threshold * np.maximum(a.size[:, None], b.size) - 1e-9
    if within:
        alive &= np.triu(np.ones(alive.shape, dtype=bool), 1)
    i, j = np.nonzero(alive)
    matches = np.zeros(len(i), dtype=np.int32)
    for n, least in fewest_matches(threshold, tolerance, VALUES, STEP):
        if not len(i):
            return []
        a.upto(np.unique(i), n)
        b.upto(np.unique(j), n)
        for at in range(0, len(i), 200_000):
            p, q = i[at : at + 200_000], j[at : at + 200_000]
            matches[at : at + 200_000] += (a.values[p, n - STEP : n] == b.values[q, n - STEP : n]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return _exact(a.grams, b.grams, a.size, b.size, i, j, threshold)


def _exact(left, right, na, nb, i, j, threshold) -> list[tuple[int, int]]:
    if not len(i):
        return []
    rows, columns = np.unique(i), np.unique(j)
    if len(i) < 4 * (len(rows) + len(columns)):
        both = np.array([len(np.intersect1d(left[p], right[q], assume_unique=True)) for p, q in zip(i, j)])
    else:  # many pairs of few sets: intersections as products of 0/1 matrices, some grams at a time
        grams = np.unique(np.concatenate([*(left[p] for p in rows), *(right[q] for q in columns)]))
        overlap = np.zeros((len(rows), len(columns)), dtype=np.float64)
        for at in range(0, len(grams), 8192):
            part = grams[at : at + 8192]
            a, b = _incidence([left[p] for p in rows], part), _incidence([right[q] for q in columns], part)
            overlap += a @ b.T
        both = overlap[np.searchsorted(rows, i), np.searchsorted(columns, j)]
    keep = both >= threshold * (na[i] + nb[j] - both) - 1e-9
    return list(zip(i[keep].tolist(), j[keep].tolist()))


def _incidence(sets: list[np.ndarray], grams: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(grams)), dtype=np.float32)
    for k, s in enumerate(sets):
        s = s[np.searchsorted(s, grams[0]) : np.searchsorted(s, grams[-1], side="right")]
        out[k, np.searchsorted(grams, s)] = 1
    return out


def _sketch(bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                nodes, sizes, keys = [], [], []
                for text in part.column(2).cast(pa.binary()).to_pylist():
                    grams = shingles(text or b"", words)
                    if not len(grams):
                        nodes.append(None)
                        sizes.append(0)
                        keys.append(None)
                        continue
                    nodes.append(_digest(grams))
                    sizes.append(len(grams))
                    values = minhash(grams, bands * rows, 7)
                    keys.append([xxhash.xxh3_64_intdigest(values[i * rows : (i + 1) * rows].tobytes(), seed=i) - (1 << 63) for i in range(bands)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "mark", "node", "size", "bands"])

    return run


def _union(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _verify(words: int, threshold: float, tolerance: float, as_pairs: bool):
    """Streams tasks (cluster, i, j), each a run of rows; a row is a class with its text, its bands and its block."""

    def solve(i: int, j: int, members: list[tuple[bytes, int, list[int], bytes]]) -> list[tuple]:
        # A class can come with texts of several rows; the row whose text is not of the class is dropped.
        sides: tuple[dict, dict] = ({}, {})
        for node, block, bands, text in members:
            grams = shingles(text, words)
            if len(grams) and _digest(grams) == node:
                sides[0 if block == i else 1][node] = grams, bands
        if not sides[0] or (i != j and not sides[1]):
            return []
        a, b = ([*s] for s in sides)
        left, right = (Sets([g for g, _ in s.values()], np.array([k for _, k in s.values()], dtype=np.int64)) if s else None for s in sides)
        found = [(a[x], (a if i == j else b)[y]) for x, y in linked(left, None if i == j else right, threshold, tolerance)]
        if as_pairs:
            return [(min(p), max(p), 1) for p in found]
        parent: dict[bytes, bytes] = {}
        links: dict[bytes, int] = {}
        for x, y in found:
            for n in (x, y):
                parent.setdefault(n, n)
                links[n] = links.get(n, 0) + 1
            x, y = _union(parent, x), _union(parent, y)
            parent[max(x, y)] = min(x, y)
        return [(n, _union(parent, n), k) for n, k in links.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members, out = None, [], []
        for batch in batches:
            cluster, i, j, node, block, bands, text = (c.cast(pa.binary()).to_pylist() if c.type == pa.string() else c.to_pylist() for c in batch.columns)
            for key, *row in zip(zip(cluster, i, j), node, block, bands, text):
                if key != current:
                    if members:
                        out += solve(*current[1:], members)
                    current, members = key, []
                members.append((*row[:3], row[3] or b""))
            if len(out) > 2000:
                yield _rows(out)
                out = []
        if members:
            out += solve(*current[1:], members)
        yield _rows(out)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, n = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_mark(F.col(text_col)).alias("mark"), F.col(text_col).cast("string").alias("text"))


def sketches(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, node, size, bands`` of each row: digest and size of its set and its band keys; null without words."""
    return stable(_slim(docs, id_col, text_col).mapInArrow(_sketch(BANDS, ROWS, words), "doc_id long, mark long, node binary, size long, bands array<bigint>"))


def _verified(docs: DataFrame, rows: DataFrame, words: int, threshold: float, tolerance: float, block: int, as_pairs: bool, id_col: str, text_col: str) -> DataFrame:
    """``a, b, n`` of the tasks: pairs of classes, or a class, the root of its tree and its links."""
    nodes = stable(rows.where("node IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"), F.first("size").alias("grams"), F.min(F.struct("doc_id", "mark")).alias("at")))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = stable(keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("low")).where("c > 1"))
    total = shared.agg(F.sum("c")).first()[0] or 0
    stars = spread_join(keyed, shared, "key", "c", total).where("node <> low").select("node", "low").distinct()
    clusters = stable(connected_components(stars, "node", "low"))
    sized = clusters.join(nodes.select("node", "bands", "grams", "at.doc_id", "at.mark"), "node")
    sized = stable(sized)
    sizes = stable(sized.groupBy("component").agg(F.count("*").alias("c"), F.sum("grams").alias("all")))
    n = F.greatest(F.least(F.ceil(F.col("c") / block), F.lit(BLOCKS)), F.ceil(F.col("c") / max(block, MOST)), F.ceil(F.col("all") / GRAMS)).cast("int")
    members = spread_join(sized, sizes.select("component", "c", n.alias("blocks")), "component", "c", sizes.agg(F.sum("c")).first()[0] or 0)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tasks = members.select("component", "node", "bands", "doc_id", "mark", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "bands", "doc_id", "mark")
    # The join brings the text of one row of each class that has a candidate; then a task's rows meet.
    texts = _slim(docs, id_col, text_col).withColumnsRenamed({"doc_id": "row_id", "mark": "row_mark"})
    if not rows.groupBy("doc_id", "mark").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        texts = texts.dropDuplicates(["row_id", "row_mark"])  # of rows that repeat, one will do
    full = tasks.join(texts, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("mark") == F.col("row_mark")))
    order = ["component", "i", "j"]
    dealt = full.select(*order, "node", "block", "bands", "text").repartition(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_verify(words, threshold, tolerance, as_pairs), "a binary, b binary, n long")


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, class_id, exact_id, n_links`` for each row of ``docs``.

    ``exact_id``: smallest id with an equal set of 5-grams. ``class_id``: smallest id of the group that links
    connect, exact copies included. ``n_links``: other classes whose similarity with this one is at least
    ``threshold``.

    Defined cases: null, empty and blank texts have no 5-grams, link to nothing and are groups of one row's
    id each; texts under five words are one run of all their words; texts of any length count whole, and a set of
    any size is hashed in bounded memory; rows that repeat are copies; null ids stay null and never name a group
    unless all its ids are null; other columns are ignored; an empty table gives no rows.
    """
    rows = sketches(docs, words, id_col, text_col)
    found = stable(_verified(docs, rows, words, threshold, tolerance, block, False, id_col, text_col))
    links = found.groupBy("a").agg(F.sum("n").alias("n_links")).withColumnRenamed("a", "node")
    group = connected_components(found, "a", "b")
    exact = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("exact_id"), F.count("*").alias("c"))
    joined = exact.join(group, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = stable(joined.select("node", "component", "exact_id", "c", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    lowest = stable(joined.groupBy("component").agg(F.min("exact_id").alias("class_id"), F.count("*").alias("k")))
    n, k = joined.agg(F.sum("c"), F.count("*")).first()
    classes = stable(spread_join(joined, lowest, "component", "k", k).select("node", "exact_id", "class_id", "n_links", "c"))
    out = spread_join(rows.select("doc_id", "mark", "node"), classes, "node", "c", n or 0).select("doc_id", "mark", "class_id", "exact_id", "n_links")
    alone = F.col("doc_id")
    return out.unionByName(rows.where("node IS NULL").select("doc_id", "mark", alone.alias("class_id"), alone.alias("exact_id"), F.lit(0).cast("long").alias("n_links")))


def pairs(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b``: smallest ids of linked classes, ``a < b``; for corpora whose groups are small."""
    rows = sketches(docs, words, id_col, text_col)
    found = _verified(docs, rows, words, threshold, tolerance, block, True, id_col, text_col)
    exact = stable(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("exact_id")))
    named = found.join(exact.withColumnsRenamed({"node": "a", "exact_id": "x"}), "a").join(exact.withColumnsRenamed({"node": "b", "exact_id": "y"}), "b")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the smallest id, once.

    Defined cases: texts without words (null, empty, blank) stay all. Where rows repeat the kept id, one row stays
    for each different text of that id within the group's exact class, and a row that repeats entirely stays once;
    a group whose ids are all null keeps its rows of null id likewise. All columns of ``docs`` come back under
    their names, whatever these are; an empty table stays empty.
    """
    found = stable(join(docs, **options))
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    keep, own, mark = fresh(docs, "keep", "own", "mark")
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    marked = docs.withColumn(mark, text_mark(F.col(text_col)))
    named = stay.select(F.col("doc_id").alias(keep), F.col("mark").alias(own))
    kept = marked.join(named, F.col(id_col).cast("long").eqNullSafe(F.col(keep)) & (F.col(mark) == F.col(own)), "left_semi")
    if not stay.where("n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, mark])
    return kept.drop(mark)
