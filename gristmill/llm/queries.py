"""Queries ``opN_<name>`` over the driver's tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, bpe, divergence, exact_dedup, fingerprints, line_dedup, ngram_join, packing, pii, quality, secrets, substring_dedup, transactions
from .common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).drop("mark")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, by a hash of the id, are the snapshot; the others come in as a batch."""
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.dedup(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: the document's source; repository: its source and language."""
    return secrets.scan_report(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every document whose id is divisible by 20, against all documents."""
    return bm25.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


#: Stands for a secret that a deployment keeps elsewhere; equal keys link pseudonyms across runs.
PII_KEY = b"gristmill query key"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.code_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.reassembly(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_report(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_topk_search": op6_topk_search,
    "op7_pii": op7_pii,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
    "op11_transactions": op11_transactions,
    "op12_divergence": op12_divergence,
    "op13_fingerprints": op13_fingerprints,
}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _crc_steps(value: int) -> int:
    """Four steps of the reflected CRC-32 division."""
    for _ in range(4):
        value = (value >> 1) ^ (0xEDB88320 * (value & 1))
    return value


def _crc32(text: str) -> str:
    """SQL of the CRC-32 of a string's UTF-8 bytes, by half bytes, the low half first."""
    halves = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), ''), lambda d: (ascii(d) - CASE WHEN d >= 'A' THEN 55 ELSE 48 END)::BIGINT)"
    steps = f"[{', '.join(str(_crc_steps(i)) for i in range(16))}]::BIGINT[]"
    return f"xor(list_reduce({halves}, lambda c, n: xor(c >> 4, list_extract({steps}, 1 + xor(c & 15, n))), 4294967295::BIGINT), 4294967295::BIGINT)"


ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORM} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)
    """,
    "op5_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        j AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.top AS dropped
              FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM j GROUP BY doc_id
    """,
    "op11_transactions": f"""
        WITH h AS (
            SELECT d.doc_id, d.source, d.text, {_crc32("d.doc_id::VARCHAR")} AS h,
                   d.text IS NULL OR d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS gone
            FROM documents d),
        r AS (SELECT *, h % 17 AS m, CASE WHEN h % 17 >= 7 THEN (h // 100) % 30000 END AS key FROM h),
        -- The next control record decides: a rollback undoes; past a savepoint only the transaction's end counts.
        n AS (SELECT *, first_value(CASE WHEN m < 7 THEN m END IGNORE NULLS) OVER after AS next_m,
                     first_value(CASE WHEN m < 7 THEN doc_id END IGNORE NULLS) OVER after AS next_id,
                     first_value(CASE WHEN m < 3 THEN m END IGNORE NULLS) OVER after AS end_m,
                     first_value(CASE WHEN m < 3 THEN doc_id END IGNORE NULLS) OVER after AS end_id
              FROM r WINDOW after AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
        c AS (SELECT doc_id AS end_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 + 1 AS epoch, row_number() OVER (ORDER BY doc_id) AS seq FROM r WHERE m < 2),
        a AS (SELECT key, epoch, doc_id, text, gone,
                     row_number() OVER (PARTITION BY key, epoch ORDER BY seq DESC, doc_id DESC) AS back
              FROM n JOIN c USING (end_id) WHERE m >= 7 AND next_m NOT IN (5, 6)),
        v AS (SELECT key, epoch, CASE WHEN NOT gone THEN {_crc32("key || ':' || text")} END AS value FROM a WHERE back = 1),
        w AS (SELECT epoch, (value IS NOT NULL)::BIGINT AS has, coalesce(value, 0) AS value,
                     lag((value IS NOT NULL)::BIGINT, 1, 0) OVER per_key AS had, coalesce(lag(value) OVER per_key, 0) AS old
              FROM v WINDOW per_key AS (PARTITION BY key ORDER BY epoch)),
        e AS (SELECT epoch, sum(n) AS n, sum(total) AS total FROM (
                  SELECT epoch, has - had AS n, value - old AS total FROM w UNION ALL SELECT DISTINCT epoch, 0, 0 FROM c) GROUP BY epoch)
        SELECT 'state' AS kind, epoch::BIGINT AS id, (sum(n) OVER upto)::BIGINT AS n, (sum(total) OVER upto)::BIGINT AS value
        FROM e WINDOW upto AS (ORDER BY epoch)
        UNION ALL
        SELECT CASE WHEN next_m IN (5, 6) THEN 'rollback' ELSE 'abort' END, doc_id,
               CASE WHEN next_m IN (5, 6) THEN next_id ELSE end_id END, key
        FROM n WHERE m >= 7 AND (next_m IN (5, 6) OR coalesce(end_m, 2) = 2)
    """,
    "op12_divergence": """
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM t GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
        l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY lang),
        g AS (SELECT d.lang, d.source, coalesce(any_value(s.total), 0) AS total
              FROM (SELECT DISTINCT lang, source FROM d) d
              LEFT JOIN (SELECT lang, source, sum(c.n) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n,
                     1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p,
                     1 + (1000000000 * (k.n + 5)) // (l.total + 5 * l.v) AS q
              FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
                 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
              UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value,
               (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
        FROM r QUALIFY part = 'pair' OR rank <= 50
    """,
}
