"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept. All but the last
return the columns of ``documents``, with ``n_chars`` set to the length of the text as it is then (null for a null
text where a stage changes texts).

Defined cases, in every stage: a null text counts as empty and stays null until packing; texts of any length are
worked on whole; rows of null id take part like others, as the smallest id in line dedup, while the join never keeps
one beside rows with an id; extra columns, whatever their names, are dropped after a stage; an empty table gives an empty one. What ties and rows that repeat do is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import line_dedup, ngram_join, packing, quality, secrets
from gristmill.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 go. Rows that repeat score alike; a score of 0.5 stays."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 or more code points that five or more documents hold stay in the largest id only.

    All documents stay, also those that lose every line. Rows that repeat an id are one document, and each keeps
    the lines that the largest id keeps.
    """
    return _documents(line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs)))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more connect, the smallest id stays.

    Documents without words have no likeness and all stay. Rows that repeat are copies, of which one stays; of
    rows that share the smallest id but differ in text within one group one stays for each text.
    """
    return ngram_join.keep_one(docs).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; all documents stay.

    Spans that overlap or start together are replaced together; rows that repeat are redacted alike.
    """
    return _documents(secrets.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset. A null or empty text is one piece; rows that repeat are packed each."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: The classifier and the packing search are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result stored as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
