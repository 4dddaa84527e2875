"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed whole with either dictionary. The difference of the two sizes, normalised by the text's
length and by the sizes themselves, is calibrated into a probability by a logistic regression that also knows
the length and how far the text compresses at all. Dictionaries come from one half of the labelled sample and
the calibration from the other, so it sees sizes as unseen texts have them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh

#: Labelled texts of each class that the fit may take, and code points of each (a window at a hashed place).
#: Both are parameters of ``fit`` and hold at every corpus size, so the driver holds at most 2 x 2,000 x 16,000 code
#: points. ``chars=None`` lifts the second, for labelled texts that fit into the driver whole.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 2000, 16_000
DICT_BYTES, PIECE_BYTES, LEVEL = 110_000, 1000, 3


@dataclass
class Model:
    """Dictionaries as bytes, calibration weights over standardised features; no dictionaries: a constant."""

    good: bytes | None
    bad: bytes | None
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def features(self, texts: list[bytes], good, bad) -> np.ndarray:
        n = np.array([len(t) for t in texts], dtype=float) + 16
        a = np.array([len(good.compress(t)) for t in texts], dtype=float)
        b = np.array([len(bad.compress(t)) for t in texts], dtype=float)
        return np.c_[(b - a) / (a + b), (b - a) / n, np.log(n), a / n, np.log(a / n)]

    def compressors(self):
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d))
        return out

    def scores(self, texts: list[bytes], compressors) -> np.ndarray:
        if self.good is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.weights[0])))
        x = (self.features(texts, *compressors) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + PIECE_BYTES] for t in texts for i in range(0, max(len(t), 1), PIECE_BYTES)]
    size = min(DICT_BYTES, max(1024, sum(map(len, pieces)) // 4))
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves as the dictionary
        return b"\n".join(pieces)[:DICT_BYTES] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Newton steps with halving on the penalised log-likelihood."""
    x = np.c_[np.ones(len(x)), x]
    w, eye = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + ridge / 2 * w @ w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + eye, x.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def fit_texts(good: list[bytes], bad: list[bytes], n_good: int, n_bad: int) -> Model:
    """A model from sampled texts of both classes; ``n_good`` and ``n_bad`` are the counts of all labels."""
    zero = np.zeros(5)
    if len(good) < 2 or len(bad) < 2:
        odds = np.log((n_good + 1) / (n_bad + 1)) if n_good + n_bad else 0.0
        return Model(None, None, zero, zero + 1, np.r_[odds, zero])
    model = Model(_dictionary(good[::2]), _dictionary(bad[::2]), zero, zero + 1, np.zeros(6))
    rest = [*good[1::2], *bad[1::2]]
    y = np.r_[np.ones(len(good[1::2])), np.zeros(len(bad[1::2]))]
    x = model.features(rest, *model.compressors())
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic((x - model.mean) / model.scale, y)
    # Classes are sampled apart, so the intercept is moved to the odds of all labels.
    model.weights[0] += np.log(n_good / n_bad) - np.log(len(good[1::2]) / len(bad[1::2]))
    return model


def held_out(doc_id):
    """crc32 of the id as text, modulo 3, is 1; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, chars: int | None = SAMPLE_CHARS) -> Model:
    """Fits on at most ``per_class`` labelled texts of each class that are not held out.

    Which ones is fixed by a hash of the id. Ids with labels of both classes are left out, as are null labels
    and null ids; labels without a document are ignored; a null text is empty; rows that repeat an id and its text count
    once, and each class has its own bound, so repeated rows never push the other class out. With fewer than two texts
    of a class, or none, the score is the share of good labels (0.5 without any).
    """
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    agreed = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_top")).where("quality = _top").drop("_top")
    counts = {r["quality"]: r["n"] for r in agreed.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = agreed.where("quality = 1").orderBy(*by_hash).limit(per_class).unionByName(agreed.where("quality = 0").orderBy(*by_hash).limit(per_class))
    text = F.coalesce(F.col("text"), F.lit(""))
    if chars is not None:
        room = F.greatest(F.length(text) - chars, F.lit(0)) + 1
        text = F.substring(text, (F.pmod(F.xxhash64("doc_id"), room) + 1).cast("int"), F.lit(chars))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = slim.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", text.alias("text")).distinct()
    at = F.row_number().over(Window.partitionBy("quality").orderBy(*by_hash, "text"))
    rows = found.withColumn("at", at).where(F.col("at") <= per_class).orderBy("quality", "at").collect()
    good, bad = ([r["text"].encode() for r in rows if r["quality"] == q] for q in (1, 0))
    return fit_texts(good, bad, counts.get(1, 0), counts.get(0, 0))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``: the probability that the text is good, of the whole text.

    Defined cases: a null text is scored as the empty text; repeated rows each get a score; a text of any length is
    compressed whole; columns of any name and type come back, ``out`` must not be among them; an empty table stays empty.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors() if model.good is not None else None
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(texts, pair), pa.float64())], [*names, "_score"])

    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(names, docs.schema)), StructField("_score", DoubleType())])
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns, out)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per document, repeated ones and those of null id too (see ``fit``, ``score``)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(slim, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of at least 0.5, with their own columns, whatever their names (see ``fit``, ``score``)."""
    (out,) = fresh(docs, "quality_score")
    return score(docs, fit(docs, labels), out=out).where(F.col(out) >= 0.5).drop(out)
