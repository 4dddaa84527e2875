"""Queries that write a driver's table through a sink to the shared folder and read it back through a scan.

What each leaves in the shared folder is removed by an enclosing ``lineage.scope``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill import lineage
from gristmill.functions.hashing import digest
from gristmill.operators import graph, splits, validation
from gristmill.sources import archives, parts, scans, sinks
from gristmill.sources.scans import table

from .queries import _MAIL, docs, first_mail, query


def _texts(spark, sf):
    """Documents as files: name by language and id, content in UTF-8."""
    d = table(spark, sf, "documents")
    return d.select(F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("member"), F.encode("text", "UTF-8").alias("content"))


def _tars(spark, sf, packed):
    folder = lineage.scratch(spark)
    return archives.index(spark, archives.write(_texts(spark, sf), f"{folder}/tars", "member", "content", packed), f"{folder}/index")


@query("tar_members_by_locale", "SELECT lang || '/' || doc_id || '.txt' AS member, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents WHERE lang = 'de'")
def tar_members_by_locale(spark, sf):
    """Whole texts packed into tar.gz archives; those of one language read back by frames."""
    found = archives.members(_tars(spark, sf, True).where(F.startswith("member", F.lit("de/"))))
    return found.select("member", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query(
    "tar_members_by_key",
    """SELECT CASE WHEN quality = 1 THEN lang ELSE 'xx' END || '/' || l.doc_id || '.txt' AS member, CASE WHEN quality = 1 THEN sha256(text) END AS sha256
    FROM (SELECT DISTINCT doc_id, quality FROM labels) l JOIN documents USING (doc_id)""",
)
def tar_members_by_key(spark, sf):
    """Members of tar archives by name: those that labels call good, and names that no archive holds, without content."""
    labels = table(spark, sf, "labels").select("doc_id", "quality").distinct().join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    keys = labels.select(F.concat(F.when(F.col("quality") == 1, F.col("lang")).otherwise("xx"), F.lit("/"), "doc_id", F.lit(".txt")).alias("member"))
    found, missing = archives.wanted(_tars(spark, sf, False), keys, "member")
    return archives.members(found).select("member", F.sha2("content", 256).alias("sha256")).unionByName(missing.select("member", F.lit(None).cast("string").alias("sha256")))


@query("sorted_lines_roundtrip", "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus AS split FROM orders")
def sorted_lines_roundtrip(spark, sf):
    """Orders as sorted JSON lines, a folder for each status, and read again."""
    path = lineage.scratch(spark)
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderpriority", F.col("o_orderstatus").alias("split"))
    sinks.write_sorted_jsonl(rows, path, "split", ["o_orderkey"])
    return scans.jsonl(spark, path, rows.schema)


@query("gzip_lines_roundtrip", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def gzip_lines_roundtrip(spark, sf):
    path = lineage.scratch(spark)
    table(spark, sf, "documents").select("doc_id", "text").write.option("compression", "gzip").json(path)
    return scans.jsonl(spark, path, "doc_id long, text string").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("csv_roundtrip", "SELECT conv_id, turn, role, sha256(text) AS sha256 FROM conversations")
def csv_roundtrip(spark, sf):
    """Turns with line breaks and quotes through CSV with a header."""
    path, rows = lineage.scratch(spark), table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n").csv(path)
    return scans.csv(spark, path, rows.schema).select("conv_id", "turn", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query("covered_parts_roundtrip", "SELECT c_custkey, c_name FROM customer")
def covered_parts_roundtrip(spark, sf):
    """Customers written by tasks whose commit messages cover the expected keys, then published at once."""
    path, rows = f"{lineage.scratch(spark)}", table(spark, sf, "customer").select("c_custkey", "c_name")
    parts.write_covered(rows, path, ["c_custkey"], rows)
    return spark.read.parquet(path)


@query("finalized_parts", "SELECT s_suppkey, s_name FROM supplier")
def finalized_parts(spark, sf):
    """Two parts written apart, united once they are disjoint and cover all suppliers."""
    path, rows = lineage.scratch(spark), table(spark, sf, "supplier").select("s_suppkey", "s_name")
    half = F.pmod(F.xxhash64("s_suppkey"), F.lit(2))
    for i in range(2):
        rows.where(half == i).write.parquet(f"{path}/part{i}")
    return sinks.finalize_parts(spark, [f"{path}/part0", f"{path}/part1"], rows, "s_suppkey", f"{path}/whole")


@query("resumed_append", "SELECT p_partkey, p_name FROM part")
def resumed_append(spark, sf):
    """Parts appended by a run that stopped half way and one that goes on, under one lock."""
    path, rows = f"{lineage.scratch(spark)}/out", table(spark, sf, "part").select("p_partkey", "p_name")
    sinks.append_missing(rows.where(F.pmod(F.xxhash64("p_partkey"), F.lit(2)) == 0), path, "p_partkey", 64, "lock")
    sinks.append_missing(rows, path, "p_partkey", 64, "lock")
    return spark.read.parquet(path)


@query("quarantined_rows", "SELECT doc_id, CASE WHEN n_chars > 6000 THEN 'too_long' WHEN n_chars < 200 THEN 'too_short' ELSE 'accepted' END AS side FROM documents")
def quarantined_rows(spark, sf):
    """Documents beside those rejected, each with its reason, from both folders."""
    path = lineage.scratch(spark)
    reason = validation.first_reason([(F.col("n_chars") > 6000, "too_long"), (F.col("n_chars") < 200, "too_short")])
    sinks.write_quarantine(table(spark, sf, "documents").select("doc_id", "n_chars").withColumn("reason", reason), path)
    rejected = spark.read.schema("doc_id long, n_chars long, reason string").parquet(f"{path}/rejected").select("doc_id", F.col("reason").alias("side"))
    return spark.read.parquet(f"{path}/accepted").select("doc_id", F.lit("accepted").alias("side")).unionByName(rejected)


@query(
    "moved_locks",
    """WITH s AS (SELECT n_nationkey, count(s_suppkey) > avg(count(s_suppkey)) OVER () AS moved FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT n_name AS repo, md5(n_name) AS pinned, md5(n_name || '+') AS head FROM nation JOIN s USING (n_nationkey) WHERE moved""",
)
def moved_locks(spark, sf):
    """A lock file of nations as sources; those with more suppliers than the mean have a new head."""
    nation, path = table(spark, sf, "nation"), lineage.scratch(spark)
    sinks.write_lock(nation.select(F.col("n_name").alias("repo"), F.md5(F.col("n_name")).alias("revision")), path)
    pins = scans.jsonl(spark, path, "repo string, revision string")
    counts = nation.join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))  # one row
    name = F.concat("n_name", F.when(F.col("n") > F.col("mean"), "+").otherwise(""))
    heads = counts.crossJoin(F.broadcast(mean)).select(F.col("n_name").alias("repo"), F.md5(name).alias("revision"))
    return scans.locked(pins, heads)


@query("rewritten_keys", "SELECT doc_id, lang, CASE WHEN quality = 0 THEN 'low' ELSE source END AS source FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)")
def rewritten_keys(spark, sf):
    """Group keys of documents that labels call bad, replaced in the partitions that hold them."""
    path = lineage.scratch(spark)
    table(spark, sf, "documents").select("doc_id", "source", "lang").write.partitionBy("lang").parquet(path)
    bad = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 0").select("doc_id", F.lit("low").alias("source"))
    sinks.rewrite_keys(spark, path, "lang", bad, "doc_id", "source")
    return spark.read.parquet(path).select("doc_id", "lang", "source")


@query("immutable_result", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def immutable_result(spark, sf):
    """A result that a second run finds, and that another result would not replace."""
    path, rows = lineage.scratch(spark), table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    sinks.write_once(rows, path)
    return sinks.write_once(rows, path)


@query("release_readback", "SELECT o_orderstatus AS split, 'missing' AS state FROM orders GROUP BY 1 HAVING count(*) < (SELECT count(*) / count(DISTINCT o_orderstatus) FROM orders)")
def release_readback(spark, sf):
    """A release by status, packaged; after its small splits are gone, the read-back reports their files."""
    path = lineage.scratch(spark)
    orders = table(spark, sf, "orders")
    sinks.write_splits(orders.select("o_orderkey", F.col("o_orderstatus").alias("split")), path, "split", ["o_orderkey"])
    before = lineage.stable(sinks.packaged(spark, path))
    mean = orders.agg((F.count("*") / F.count_distinct("o_orderstatus")).alias("mean"))  # one row
    small = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).crossJoin(F.broadcast(mean)).where("n < mean")
    for r in small.select("o_orderstatus").collect():  # a split each
        lineage.removed(spark, f"{path}/split={r[0]}")
    gone = sinks.readback(spark, path, before).where("now IS NULL")
    return gone.select(F.regexp_extract("file", "split=([^/]*)/", 1).alias("split"), F.lit("missing").alias("state")).distinct()


@query("built_stage", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def built_stage(spark, sf):
    """A stage made from documents and found again by the state of its inputs."""
    cache = lineage.scratch(spark)
    scans.builder("source_counts")(_source_counts)
    scans.built(spark, "source_counts", f"{sf}/documents.parquet", cache)
    return scans.built(spark, "source_counts", f"{sf}/documents.parquet", cache)


def _source_counts(spark, path):
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


_WORD8 = "('0x' || substr(sha256(doc_id || ':' || text), {}, 8))::BIGINT"


@query(
    "documents_manifest",
    f"""WITH w AS (SELECT source, {_WORD8.format(1)} AS a, {_WORD8.format(9)} AS b FROM documents)
    SELECT source, count(*) AS n, sum(a)::BIGINT AS sum, bit_xor(a) AS xor, sum(b)::BIGINT AS sum2, bit_xor(b) AS xor2 FROM w GROUP BY 1""",
)
def documents_manifest(spark, sf):
    """A manifest of each source's documents that no task has to gather."""
    return sinks.hash_manifest(table(spark, sf, "documents"), ["source"], digest("doc_id", "text"))


@query(
    "line_options",
    """WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: lower(trim(x))) AS o FROM documents)
    SELECT doc_id, CASE WHEN len(o) < 2 THEN 'too_few_options' WHEN len(o) > 10 THEN 'too_many_options' WHEN list_contains(o, '') THEN 'blank_option'
                        WHEN len(list_distinct(o)) < len(o) THEN 'duplicate_option' END AS reason FROM l""",
)
def line_options(spark, sf):
    """The lines of each document as options of a question: which of them are no valid list."""
    return table(spark, sf, "documents").select("doc_id", validation.options_reason(F.split("text", "\n")).alias("reason"))


_FOUR = "[x::DOUBLE FOR x IN embedding[1:4]]"


@query(
    "vector_probabilities",
    f"""WITH v AS (SELECT vec_id, {_FOUR} AS x FROM embeddings), s AS (SELECT vec_id, x, list_sum(x) AS s, x[1] * x[1] + x[2] * x[2] + x[3] * x[3] + x[4] * x[4] AS q FROM v),
    p AS (SELECT vec_id, list_transform(x, lambda e: round(e * e / q, 2)) AS squares, list_transform(x, lambda e: e / s) AS shares FROM s)
    SELECT vec_id, CASE WHEN abs(list_sum(squares) - 1) > 0.001 THEN 'sum_not_one' END AS rounded,
           CASE WHEN len(list_filter(shares, lambda e: e < 0 OR e > 1)) > 0 THEN 'out_of_range' END AS signed FROM p""",
)
def vector_probabilities(spark, sf):
    """Squares of four components as probabilities of two digits, which may miss 1, and their signed shares, which may be out of range."""
    x = F.transform(F.slice("embedding", 1, 4), lambda e: e.cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, e: a + e)
    v = table(spark, sf, "embeddings").select("vec_id", x.alias("x"))
    v = v.select("vec_id", "x", total(F.transform("x", lambda e: e * e)).alias("q"), total(F.col("x")).alias("s"))
    squares, shares = F.transform("x", lambda e: F.round(e * e / F.col("q"), 2)), F.transform("x", lambda e: e / F.col("s"))
    return v.select("vec_id", validation.probabilities_reason(squares, F.lit(4)).alias("rounded"), validation.probabilities_reason(shares, F.lit(4)).alias("signed"))


@query(
    "incremental_components",
    f"""WITH RECURSIVE k AS (SELECT doc_id, 'c' || sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')))) AS key FROM documents
        UNION SELECT doc_id, 'm' || regexp_extract(text, '{_MAIL}') FROM documents WHERE regexp_extract(text, '{_MAIL}') <> ''),
    e AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM k a JOIN k b USING (key)),
    r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
    SELECT x AS doc_id, min(y) AS component FROM r GROUP BY x""",
)
def incremental_components(spark, sf):
    """Documents linked by equal contents or the same first mail address, in three batches; a component's smallest id."""
    d = lineage.stable(docs(spark, sf).select("doc_id", "content", first_mail().alias("mail")))
    key = F.explode(F.array_compact(F.array(F.concat(F.lit("c"), "content"), F.concat(F.lit("m"), "mail"))))
    # Nodes are ordered pairs, so a document is before every key.
    node = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    pairs = d.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"))
    links = lineage.stable(pairs.select("doc_id", node(0, F.lpad(F.col("doc_id").cast("string"), 20, "0")).alias("a"), node(1, F.col("key")).alias("b")))
    forest = None
    for batch in range(3):
        some = links.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == batch)
        forest, _ = graph.grow(forest, some, batch, lambda c: splits.ladder(F.pmod(F.xxhash64(c), F.lit(100)), [(80, "train"), (90, "dev")], "test"))
    return forest.nodes.where("node.kind = 0").select(F.col("node.name").cast("long").alias("doc_id"), F.col("component.name").cast("long").alias("component"))
