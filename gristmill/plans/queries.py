"""Named queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.hashing import bucket, digest, full_mod, hash8, normalised, synthetic_score
from gristmill.operators import leakage, sampling, splits, typed, validation
from gristmill.sources.scans import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Order priorities as the options of the stand-in questions.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PR = "['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW']"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_NORM = "lower(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')))"
_MAIL = "[A-Za-z0-9.]+@[a-z0-9]+[.][a-z.]+"
_B8 = "(('0x' || substr(sha256({}), 1, 8))::BIGINT % {})"
_LADDER = "CASE WHEN {0} < 60 THEN 'train' WHEN {0} < 70 THEN 'dev' WHEN {0} < 85 THEN 'calibration' ELSE 'test' END"
_PRIO = "CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 WHEN 'calibration' THEN 2 ELSE 3 END"
_DOCS = f"""d0 AS (SELECT *, {_B8.format("source || ':' || doc_id", 100)} AS b FROM documents),
    d AS (SELECT *, {_LADDER.format('b')} AS split, sha256({_NORM}) AS content FROM d0)"""


def query(name: str, sql: str | None = None):
    """Registers a query and its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a hashed split and the digest of their normalised text."""
    return table(spark, sf, "documents").withColumn("split", splits.hashed("source", "doc_id")).withColumn("content", F.sha2(normalised("text"), 256))


def first_mail() -> Column:
    """The first mail address of a text as a second key; null without one, and nulls are no keys."""
    return F.nullif(F.regexp_extract("text", _MAIL, 0), F.lit(""))


def priorities() -> Column:
    return F.array(*map(F.lit, PRIORITIES))


# Corpus identity, splits and leakage.


@query("owner_split_clean", f"""WITH {_DOCS},
    p AS (SELECT *, {_PRIO} AS p FROM d),
    o AS (SELECT content, max(p) AS owner FROM p GROUP BY content)
    SELECT split, lang, count(*) AS n FROM p JOIN o USING (content) WHERE p >= owner GROUP BY split, lang""")
def owner_split_clean(spark, sf):
    clean = leakage.owner_split(docs(spark, sf).select("doc_id", "split", "lang", "content"), "doc_id", {"content": F.col("content")})
    return clean.groupBy("split", "lang").agg(F.count("*").alias("n"))


@query("hash_bucket_split", f"""WITH b AS (SELECT doc_id, list_reduce(list_transform(string_split(sha256('pilot:' || source || ':' || doc_id), ''), lambda c: ('0x' || c)::INT), lambda a, c: (a * 16 + c) % 100, 0) AS bucket FROM documents)
    SELECT doc_id, bucket, {_LADDER.format('bucket')} AS split FROM b""")
def hash_bucket_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", full_mod(digest(F.lit("pilot"), "source", "doc_id"), 100).alias("bucket"))
    return d.withColumn("split", splits.ladder(F.col("bucket"), [(60, "train"), (70, "dev"), (85, "calibration")], "test"))


@query("official_split", f"""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'test' WHEN 'P' THEN 'calibration' ELSE
    CASE WHEN {_B8.format('o_orderkey::VARCHAR', 100)} < 70 THEN 'train' WHEN {_B8.format('o_orderkey::VARCHAR', 100)} < 85 THEN 'dev' ELSE 'calibration' END END AS split FROM orders""")
def official_split(spark, sf):
    fallback = splits.hashed("o_orderkey", steps=((70, "train"), (85, "dev")), last="calibration")
    return table(spark, sf, "orders").select("o_orderkey", splits.official_first(F.col("o_orderstatus"), fallback, {"F": "test", "P": "calibration"}).alias("split"))


@query("rare_class_move", f"""WITH s AS (SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN {_B8.format('c_nationkey::VARCHAR', 100)} < 80 THEN 'train' ELSE 'test' END AS split FROM customer),
    m AS (SELECT c_nationkey AS g FROM s WHERE split = 'train' AND c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY sha256(c_nationkey::VARCHAR), 1 LIMIT 1),
    h AS (SELECT count(*) AS c FROM s WHERE split = 'calibration' AND c_mktsegment = 'BUILDING')
    SELECT CASE WHEN h.c = 0 AND m.g IS NOT NULL AND split = 'train' THEN 'calibration' ELSE split END AS split, count(*) AS n
    FROM s CROSS JOIN h LEFT JOIN m ON s.c_nationkey = m.g GROUP BY 1""")
def rare_class_move(spark, sf):
    c = table(spark, sf, "customer").withColumn("split", splits.hashed("c_nationkey", steps=((80, "train"),)))
    return splits.move_rare(c, "c_nationkey", F.col("c_mktsegment") == "BUILDING").groupBy("split").agg(F.count("*").alias("n"))


@query("bucket_shards", f"SELECT {_B8.format('doc_id::VARCHAR', 8)}::INT AS shard, count(*) AS n FROM documents GROUP BY 1")
def bucket_shards(spark, sf):
    return sampling.sharded(table(spark, sf, "documents").select("doc_id"), 8, "doc_id").groupBy("shard").agg(F.count("*").alias("n"))


@query("pack_index", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents)
    SELECT doc_id, source, r // 64 AS pack, (r % 64)::INT AS place FROM r""")
def pack_index(spark, sf):
    return sampling.packed(table(spark, sf, "documents").select("doc_id", "source"), ["source"], ["doc_id"])


@query("expected_packs", f"""WITH s AS (SELECT {_B8.format('doc_id::VARCHAR', 8)} AS shard, count(*) AS n FROM documents GROUP BY 1)
    SELECT sum(ceil(n / 64.0))::BIGINT AS packs, sum(n)::BIGINT AS rows FROM s""")
def expected_packs(spark, sf):
    from gristmill.operators.metrics import expected_packs as packs

    return packs(table(spark, sf, "documents"), bucket(digest("doc_id"), 8))


@query("normalised_dedupe_keep_first", f"""WITH {_DOCS}, r AS (SELECT doc_id, content, row_number() OVER (PARTITION BY content ORDER BY {_PRIO} DESC, doc_id) AS rn FROM d)
    SELECT doc_id, content FROM r WHERE rn = 1""")
def normalised_dedupe_keep_first(spark, sf):
    d = docs(spark, sf).select("doc_id", "content", "split").withColumn("p", splits.priority(F.col("split")))
    return leakage.keep_first(d, ["content"], [F.desc("p"), "doc_id"]).select("doc_id", "content")


@query("decision_fingerprint", """SELECT o_orderkey, sha256(concat(coalesce(o_orderstatus, ''), chr(31), coalesce(o_orderpriority, ''), chr(31), coalesce(o_custkey::VARCHAR, ''))) AS fingerprint FROM orders""")
def decision_fingerprint(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", typed.fingerprint("o_orderstatus", "o_orderpriority", "o_custkey").alias("fingerprint"))


@query("train_holdout_multikey_anti", f"""WITH {_DOCS}, h AS (SELECT DISTINCT content FROM d WHERE split <> 'train'), m AS (SELECT *, nullif(regexp_extract(text, '{_MAIL}'), '') AS mail FROM d), g AS (SELECT DISTINCT mail FROM m WHERE split <> 'train' AND mail IS NOT NULL)
    SELECT split, count(*) AS n FROM m WHERE split <> 'train' OR (content NOT IN (SELECT content FROM h) AND (mail IS NULL OR mail NOT IN (SELECT mail FROM g))) GROUP BY split""")
def train_holdout_multikey_anti(spark, sf):
    d = docs(spark, sf).select("doc_id", "split", "content", first_mail().alias("mail"))
    return leakage.multi_key_anti(d, "doc_id", {"content": F.col("content"), "mail": F.col("mail")}).groupBy("split").agg(F.count("*").alias("n"))


@query("protected_benchmark_anti", f"""WITH {_DOCS}, l AS (SELECT DISTINCT doc_id, sha256(lower(trim(x))) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d)),
    p AS (SELECT DISTINCT sha256(lower(trim(text))) AS k FROM benchmark)
    SELECT d.doc_id FROM d WHERE NOT (split = 'train' AND doc_id IN (SELECT doc_id FROM l JOIN p USING (k)))""")
def protected_benchmark_anti(spark, sf):
    d = docs(spark, sf).select("doc_id", "split", "text")
    key = lambda c: F.sha2(F.lower(F.trim(c)), 256)
    lines = F.transform(F.split("text", "\n"), key)
    hit = d.where("split = 'train'").select("doc_id", F.explode(F.array_distinct(lines)).alias("k")).join(table(spark, sf, "benchmark").select(key(F.col("text")).alias("k")).distinct(), "k", "left_semi")
    return leakage.protected_anti(d, "doc_id", hit).select("doc_id")


@query("benchmark_overlap_audit", """WITH w AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), a AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS k FROM w),
    v AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark), b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS k FROM v),
    x AS (SELECT k, count(DISTINCT doc_id) AS n_a, min(doc_id) AS first_a FROM a GROUP BY 1), y AS (SELECT k, count(DISTINCT item_id) AS n_b, min(item_id) AS first_b FROM b GROUP BY 1)
    SELECT sha256(k) AS k, n_a, first_a, n_b, first_b FROM x JOIN y USING (k)""")
def benchmark_overlap_audit(spark, sf):
    def grams(df, row):
        w = df.select(row, F.split(F.lower("text"), " ").alias("w")).where("size(w) >= 8")
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 8), " ")))
        return w.select(row, F.explode(F.array_distinct(runs)).alias("h"))

    # Hashes of the documents' runs meet those of the items first; the text of a run is taken from the items.
    items = table(spark, sf, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("w")).where("size(w) >= 8")
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, 8), " "))
    b = items.select("item_id", F.explode(F.array_distinct(runs)).alias("g")).select("item_id", F.xxhash64("g").alias("h"), F.sha2("g", 256).alias("k"))
    a = grams(table(spark, sf, "documents"), "doc_id").join(b.select("h", "k").distinct(), "h").select("doc_id", "k")
    return leakage.overlap_audit(a, b.select("item_id", "k"), "k", "doc_id", "item_id")


@query("cross_split_groups", f"""WITH {_DOCS} SELECT content, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS n FROM d GROUP BY content HAVING count(DISTINCT split) > 1""")
def cross_split_groups(spark, sf):
    return leakage.cross_split_groups(docs(spark, sf).select("content", "split"), "content")


@query("conflicting_labels", f"""WITH {_DOCS}, j AS (SELECT content, quality * 2 + toxic AS label FROM d JOIN labels USING (doc_id) UNION ALL SELECT content, 9 FROM d WHERE source = 'src7')
    SELECT content, count(DISTINCT label) AS labels, count(*) AS n FROM j GROUP BY 1 HAVING count(DISTINCT label) > 1""")
def conflicting_labels(spark, sf):
    """Labels of the table, and those of a second annotator who calls all of one source bad, on the digest of whole texts."""
    d = docs(spark, sf).select("doc_id", "source", "content")
    first = d.join(table(spark, sf, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label")), "doc_id").select("content", "label")
    second = d.where("source = 'src7'").select("content", F.lit(9).alias("label"))
    return leakage.conflicting(first.unionByName(second), "content", "label")


@query("label_bijection_audit", """SELECT 'p_brand->p_type' AS side, p_brand AS value, count(DISTINCT p_type) AS targets FROM part GROUP BY 2 HAVING targets > 1
    UNION ALL SELECT 'p_type->p_brand', p_type, count(DISTINCT p_brand) AS targets FROM part GROUP BY 2 HAVING count(DISTINCT p_brand) > 1""")
def label_bijection_audit(spark, sf):
    return leakage.bijection_audit(table(spark, sf, "part"), "p_brand", "p_type")


@query("quarantine_groups", """WITH n AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS c FROM orders GROUP BY 1)
    SELECT CASE WHEN c > 1 THEN 'quarantined' ELSE 'kept' END AS side, count(*) AS n FROM orders JOIN n USING (o_custkey) GROUP BY 1""")
def quarantine_groups(spark, sf):
    kept, out = leakage.quarantine_groups(table(spark, sf, "orders").select("o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus")
    return kept.withColumn("side", F.lit("kept")).unionByName(out.withColumn("side", F.lit("quarantined"))).groupBy("side").agg(F.count("*").alias("n"))


@query("priority_duplicate_report", """WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER w AS rn, first_value(event_id) OVER w AS kept FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
    SELECT event_id, kept FROM r WHERE rn > 1""")
def priority_duplicate_report(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return leakage.keep_first(e, ["user_id", "event_type"], ["ts", "event_id"], "event_id").where("rn > 1").select("event_id", "kept")


@query("coverage_check", """SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing,
    (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS extra,
    (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) AS duplicated""")
def coverage_check(spark, sf):
    return leakage.coverage(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("collapse_duplicates", f"""WITH {_DOCS}, j AS (SELECT doc_id, content, quality FROM d JOIN labels USING (doc_id)), bad AS (SELECT content FROM j GROUP BY 1 HAVING count(DISTINCT quality) > 1)
    SELECT min(doc_id) AS doc_id, content FROM j WHERE content NOT IN (SELECT content FROM bad) GROUP BY content""")
def collapse_duplicates(spark, sf):
    d = docs(spark, sf).select("doc_id", "content").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return leakage.collapse(d, "content", "quality", ["doc_id"]).select("doc_id", "content")


@query("group_disjoint", "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def group_disjoint(spark, sf):
    return leakage.keys_disjoint(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("symmetric_difference", """WITH a AS (SELECT DISTINCT user_id * 1000 + event_id % 1000 AS k FROM events WHERE event_type IN ('click', 'view')), b AS (SELECT DISTINCT user_id * 1000 + event_id % 1000 AS k FROM events WHERE event_type <> 'view')
    SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def symmetric_difference(spark, sf):
    """Keys of users and items that one kind of events has and the other lacks."""
    e = table(spark, sf, "events").select((F.col("user_id") * 1000 + F.col("event_id") % 1000).alias("k"), "event_type")
    return leakage.symmetric_difference(e.where("event_type IN ('click', 'view')").select("k").distinct(), e.where("event_type <> 'view'").select("k").distinct())


@query("subset_replacement", """SELECT status, count(*) AS n, sum(k)::BIGINT AS keys FROM (SELECT o_orderstatus AS status, o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'P', o_orderkey FROM orders WHERE o_orderpriority = '5-LOW') GROUP BY 1""")
def subset_replacement(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("k"), "o_orderpriority")
    full = o.where("o_orderpriority = '5-LOW'").withColumn("status", F.lit("P"))
    return leakage.replace_subset(o, full, F.col("status") == "P").groupBy("status").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("array_overlap_anti", """WITH u AS (SELECT user_id, list(DISTINCT (event_id % 997)) AS items FROM events GROUP BY 1) SELECT user_id FROM u WHERE NOT list_has_any(items, [1, 2, 3, 5])""")
def array_overlap_anti(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("event_id") % 997).alias("m"))
    u = e.groupBy("user_id").agg(F.collect_set("m").alias("items"))
    protected = spark.createDataFrame([(1,), (2,), (3,), (5,)], "m long")
    return leakage.array_overlap(u, "user_id", F.col("items"), protected, "m").select("user_id")


# Constructors, options and reasons.


def _flat(options: str) -> Column:
    return F.array_join(F.transform(options, lambda o: F.concat_ws("=", o["key"], o["text"])), "|")


_LET = "list_transform(range(1, len({0}) + 1), lambda i: chr((64 + i)::INT) || '=' || {0}[i])"


@query("choice_rows", f"""SELECT o_orderkey, array_to_string({_LET.format(_PR)}, '|') AS options, chr((64 + list_position({_PR}, o_orderpriority))::INT) AS gold FROM orders""")
def choice_rows(spark, sf):
    o = table(spark, sf, "orders")
    options, gold = typed.choice(priorities(), F.col("o_orderpriority"))
    return o.select("o_orderkey", options.alias("o"), gold.alias("gold")).select("o_orderkey", _flat("o").alias("options"), "gold")


@query("noul_rows", "SELECT o_orderkey, 'false=false|true=true' AS options, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS gold FROM orders")
def noul_rows(spark, sf):
    options, gold = typed.noul(F.col("o_orderstatus") == "F")
    return table(spark, sf, "orders").select("o_orderkey", options.alias("o"), gold.alias("gold")).select("o_orderkey", _flat("o").alias("options"), "gold")


@query("score_rows", f"""SELECT o_orderkey, array_to_string(list_transform(range(1, 6), lambda i: (i - 1)::VARCHAR || '=' || {_PR}[i]), '|') AS options, (substr(o_orderpriority, 1, 1)::INT - 1)::VARCHAR AS gold FROM orders""")
def score_rows(spark, sf):
    options, gold = typed.score(priorities(), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return table(spark, sf, "orders").select("o_orderkey", options.alias("o"), gold.alias("gold")).select("o_orderkey", _flat("o").alias("options"), "gold")


@query("decision_rows", f"""SELECT substr(sha256('documents:' || source || ':' || doc_id), 1, 24) AS id, 'text' AS modality, lang AS task_family, source AS grp, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS gold, length(text) AS chars
    FROM documents JOIN labels USING (doc_id) WHERE length(trim(text)) > 0 AND length(text) <= 6000""")
def decision_rows(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where("length(trim(text)) > 0 AND length(text) <= 6000")
    options, gold = typed.noul(F.col("quality") == 1)
    source = F.struct(F.lit("documents").alias("repo"), F.lit("synthetic").alias("revision"), F.col("doc_id").cast("string").alias("row"), F.col("source").alias("group"), F.lit(None).cast("string").alias("original_split"), F.lit(None).cast("map<string,string>").alias("attrs"))
    question = F.struct(F.lit("noul").alias("type"), F.lit("Is the text good?").alias("instructions"), options.alias("options"))
    rows = d.select(*typed.decision(id=F.substring(digest(F.lit("documents"), "source", "doc_id"), 1, 24), modality=F.lit("text"), task_family=F.col("lang"), source=source, state=F.col("text"), question=question, gold=F.struct(gold.alias("key"), F.lit("labels").alias("provenance"))))
    return rows.select("id", "modality", "task_family", F.col("source.group").alias("grp"), F.col("gold.key").alias("gold"), F.length("state").alias("chars"))


@query("option_rotation", f"""WITH h AS (SELECT o_orderkey, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 5 AS k FROM orders)
    SELECT o_orderkey, array_to_string(list_concat({_PR}[k + 1:5], {_PR}[1:k]), '|') AS options FROM h""")
def option_rotation(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(typed.rotate_by_hash(priorities(), hash8(digest("o_orderkey"))), "|").alias("options"))


@query("option_rotations_all", f"""SELECT o_orderkey, k::INT AS shift, array_to_string(list_concat({_PR}[k + 1:5], {_PR}[1:k]), '|') AS options FROM orders, range(5) t(k)""")
def option_rotations_all(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", priorities().alias("v"))
    return typed.all_rotations(o, "v").select("o_orderkey", "shift", F.array_join("rotated", "|").alias("options"))


@query("option_hash_order", f"""WITH e AS (SELECT o_orderkey, unnest({_PR}) AS v FROM orders) SELECT o_orderkey, string_agg(v, '|' ORDER BY sha256(o_orderkey || ':' || v)) AS options FROM e GROUP BY 1""")
def option_hash_order(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(typed.hash_order(priorities(), "o_orderkey"), "|").alias("options"))


@query("prompt_rows", f"""SELECT o_orderkey, '{{"state":"' || o_orderstatus || '","question":"Which priority?","options":{{"A":"1-URGENT","B":"2-HIGH","C":"3-MEDIUM","D":"4-NOT SPECIFIED","E":"5-LOW"}}}}' AS prompt FROM orders""")
def prompt_rows(spark, sf):
    options, _ = typed.choice(priorities(), F.lit("5-LOW"))
    return table(spark, sf, "orders").select("o_orderkey", options.alias("o"), "o_orderstatus").select("o_orderkey", typed.prompt(F.col("o_orderstatus"), F.lit("Which priority?"), F.col("o")).alias("prompt"))


@query("skip_reasons", f"""WITH r AS (SELECT CASE WHEN trim(text, {_WS}) = '' THEN 'blank' WHEN length(text) > 6000 THEN 'too_long' WHEN lang <> 'en' THEN 'language' END AS reason FROM documents)
    SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1""")
def skip_reasons(spark, sf):
    reason = validation.first_reason([(F.regexp_replace("text", r"[ \t\n\x0b\f\r]+", "") == "", "blank"), (F.length("text") > 6000, "too_long"), (F.col("lang") != "en", "language")])
    return validation.reason_counts(table(spark, sf, "documents").select(reason.alias("reason")))


@query("option_reasons", """WITH o AS (SELECT p_partkey, string_split(p_name, ' ') AS v FROM part), l AS (SELECT p_partkey, v, list_transform(v, lambda x: lower(trim(x))) AS t FROM o)
    SELECT p_partkey, CASE WHEN len(v) < 2 THEN 'too_few_options' WHEN len(v) > 10 THEN 'too_many_options' WHEN list_contains(t, '') THEN 'blank_option' WHEN len(list_distinct(t)) < len(t) THEN 'duplicate_option' END AS reason FROM l""")
def option_reasons(spark, sf):
    return table(spark, sf, "part").select("p_partkey", validation.options_reason(F.split("p_name", " ")).alias("reason"))


@query("json_props", """SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type FROM events WHERE (props->>'$.k')::BIGINT BETWEEN 10 AND 60""")
def json_props(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), "event_type")
    return e.where(F.col("k").between(10, 60))


@query("single_sentence_match", """SELECT doc_id, m[1] AS code FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{3}-[0-9]{4}') AS m FROM documents) WHERE len(m) = 1""")
def single_sentence_match(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", validation.single_match(F.col("text"), r"[0-9]{3}-[0-9]{4}").alias("code"))
    return d.where("code IS NOT NULL")


@query("boxes_in_screen", """SELECT count(*) AS n, count(*) FILTER (WHERE w > 0 AND h > 0 AND l >= 0 AND t >= 0 AND l + w <= 50 AND t + h <= 50) AS inside FROM
    (SELECT l_quantity AS l, l_linenumber * 5.0 AS t, l_discount * 100 AS w, l_tax * 100 AS h FROM lineitem)""")
def boxes_in_screen(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("l"), (F.col("l_linenumber") * 5.0).alias("t"), (F.col("l_discount") * 100).alias("w"), (F.col("l_tax") * 100).alias("h"))
    return b.agg(F.count("*").alias("n"), F.count_if(validation.inside({c: F.col(c) for c in "ltwh"}, F.lit(50.0), F.lit(50.0))).alias("inside"))


# Ranking, quotas and sampling.


@query("hash_topn", "SELECT doc_id FROM documents ORDER BY sha256('top:' || doc_id), doc_id LIMIT 100")
def hash_topn(spark, sf):
    return sampling.hash_top(table(spark, sf, "documents").select("doc_id"), 100, "doc_id", seed="top")


@query("stratum_quota", """WITH r AS (SELECT p_partkey, p_type, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(p_partkey::VARCHAR)) AS rn FROM part), q AS (SELECT p_brand, 1 + count(*) % 7 AS quota FROM part GROUP BY 1)
    SELECT p_partkey, p_brand FROM r JOIN q USING (p_brand) WHERE rn <= quota""")
def stratum_quota(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    quota = p.groupBy("p_brand").agg((1 + F.count("*") % 7).alias("quota"))
    return sampling.stratum_quota(p, ["p_brand"], [digest("p_partkey")], quota).select("p_partkey", "p_brand")


@query("class_cap_union", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) AS rn FROM documents)
    SELECT doc_id, lang FROM r WHERE rn <= 50 UNION ALL (SELECT doc_id, lang FROM r WHERE rn > 50 ORDER BY sha256(doc_id::VARCHAR) LIMIT 100)""")
def class_cap_union(spark, sf):
    return sampling.class_cap_union(table(spark, sf, "documents").select("doc_id", "lang"), "lang", 50, 100, [digest("doc_id")])


@query("round_robin_cap", """WITH a AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY sha256(doc_id::VARCHAR)) AS rn FROM documents),
    b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rn, lang) AS k FROM a) SELECT doc_id, source, lang, k::INT AS k FROM b WHERE k <= 20""")
def round_robin_cap(spark, sf):
    return sampling.round_robin(table(spark, sf, "documents").select("doc_id", "source", "lang"), "source", "lang", [digest("doc_id")], 20)


@query(
    "round_robin_from_end",
    """WITH a AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id DESC) AS rn FROM documents),
    b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rn, lang) AS k FROM a) SELECT doc_id, source, lang, k::INT AS k FROM b WHERE k <= 30""",
)
def round_robin_from_end(spark, sf):
    """Each source's languages in turn give their longest document that is left: the end of a list by length."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return sampling.round_robin(d, "source", "lang", ["n_chars", "doc_id"], 30, from_end=True).select("doc_id", "source", "lang", "k")


@query("quota_with_fallback", """WITH a AS (SELECT event_id, event_type, user_id % 5 AS fam, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY sha256(event_id::VARCHAR)) AS rn FROM events),
    b AS (SELECT *, CASE WHEN rn <= 20 THEN 1 ELSE 2 END AS pass FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY pass, sha256(event_id::VARCHAR)) AS k FROM b)
    SELECT event_id, event_type, fam, pass::INT AS pass FROM c WHERE k <= 130""")
def quota_with_fallback(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", (F.col("user_id") % 5).alias("fam"))
    totals = e.select("event_type").distinct().withColumn("total", F.lit(130))
    return sampling.quota_with_fallback(e, "event_type", "fam", [digest("event_id")], 20, totals).select("event_id", "event_type", "fam", "pass")


# A fold: of each source the first of the hard and of the diverse order in turn that is not taken yet.
@query(
    "hard_diverse_interleave",
    """WITH RECURSIVE o AS (SELECT source, list(doc_id ORDER BY n_chars DESC, doc_id) AS hard, list(doc_id ORDER BY sha256(doc_id::VARCHAR), doc_id) AS diverse FROM documents GROUP BY source),
    s AS (SELECT source, hard, diverse, 0 AS turn, []::BIGINT[] AS taken FROM o
          UNION ALL
          SELECT source, hard, diverse, turn + 1, list_append(taken, list_filter(CASE WHEN turn % 2 = 0 THEN hard ELSE diverse END, lambda x: NOT list_contains(taken, x))[1])
          FROM s WHERE turn < least(20, len(hard)))
    SELECT source, taken[-1] AS doc_id, (turn - 1)::BIGINT AS turn FROM s WHERE turn > 0""",
)
def hard_diverse_interleave(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", digest("doc_id").alias("h"))
    return sampling.interleave(d, "source", "doc_id", "n_chars", "h", 20)


@query("balanced_gold_slots", """SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256(o_orderkey::VARCHAR)) - 1) % 4)::INT AS slot FROM orders""")
def balanced_gold_slots(spark, sf):
    return sampling.gold_slots(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), [digest("o_orderkey")], 4, ["o_orderstatus"]).select("o_orderkey", F.col("slot").cast("int").alias("slot"))


@query("even_spread", """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, unnest(list_transform(range(8), lambda i: round_even(i * (n - 1) / 7.0, 0)::INT)) AS place FROM n""")
def even_spread(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.explode(sampling.spread_index(F.col("n"), 8)).alias("place"))


@query("midpoint_sample", """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, unnest(list_transform(range(6), lambda i: floor((i + 0.5) * n / 6)::INT)) AS place FROM n""")
def midpoint_sample(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.explode(sampling.midpoint_index(F.col("n"), 6)).alias("place"))


@query("spread_blocks", """WITH n AS (SELECT count(*) AS n FROM orders), s AS (SELECT round_even(i * (n - 50) / 3.0, 0)::BIGINT AS s FROM n, range(4) t(i)) SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM s WHERE o_orderkey BETWEEN s AND s + 49)""")
def spread_blocks(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return sampling.spread_blocks(o, "o_orderkey", o.count(), 4, 50)


@query("held_out_per_language", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('held:' || doc_id)) AS rn FROM documents) SELECT doc_id, lang FROM r WHERE rn <= 64""")
def held_out_per_language(spark, sf):
    return sampling.stratum_quota(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], [digest(F.lit("held"), "doc_id")], 64)


@query("argmax_pick", "SELECT source, max_by(doc_id, struct_pack(a := n_chars, b := doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY source")
def argmax_pick(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query("sqrt_inverse_weights", """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS tot, count(*) AS s FROM c) SELECT source, n, round(sqrt(tot / (s * n)), 6) AS weight FROM c, t""")
def sqrt_inverse_weights(spark, sf):
    return sampling.sqrt_inverse_weights(table(spark, sf, "documents").select("source"), "source").withColumn("weight", F.round("weight", 6))


# Conversations, histories and look-ups.


@query("message_queue_oldest", """WITH u AS (SELECT * FROM conversations WHERE role = 'user') SELECT conv_id, count(*) AS n, min_by(turn, struct_pack(a := turn, b := text)) AS gold_turn, sha256(string_agg(turn || ':' || text, chr(10) ORDER BY turn, text)) AS state FROM u GROUP BY conv_id""")
def message_queue_oldest(spark, sf):
    u = table(spark, sf, "conversations").where("role = 'user'")
    queue = F.sort_array(F.collect_list(F.struct("turn", "text")))
    q = u.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("turn", F.struct("turn", "text")).alias("gold_turn"), queue.alias("q"))
    return q.select("conv_id", "n", "gold_turn", F.sha2(F.array_join(F.transform("q", lambda m: F.concat_ws(":", m["turn"].cast("string"), m["text"])), "\n"), 256).alias("state"))


@query("action_history_last5", """SELECT event_id, coalesce(array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ' > '), '') AS history FROM events""")
def action_history_last5(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1)
    return table(spark, sf, "events").select("event_id", F.array_join(F.collect_list("event_type").over(w), " > ").alias("history"))


@query(
    "distractor_self_join",
    f"""WITH {_DOCS}, t AS (SELECT content, min(source) AS low, max(source) AS high, sha256('pool:' || content) AS h FROM d GROUP BY content),
    n AS (SELECT greatest(1, (count(*) + 63) // 64) AS n FROM t),
    r AS (SELECT doc_id, source, content, ('0x' || substr(sha256('pool:' || doc_id), 1, 8))::BIGINT % n AS b, n FROM d, n),
    -- For each source the texts that others have, by hash: the first 64 are its pool.
    e AS (SELECT s.source, t.content, t.h, row_number() OVER (PARTITION BY s.source ORDER BY t.h, t.content) AS place
          FROM (SELECT DISTINCT source FROM d) s JOIN t ON NOT (s.source = low AND s.source = high)),
    c AS (SELECT doc_id, e.content AS distractor, row_number() OVER (PARTITION BY doc_id
              ORDER BY ('0x' || substr(e.h, 1, 8))::BIGINT % n <> b, sha256(doc_id || ':' || e.content)) AS rank
          FROM r JOIN e ON r.source = e.source AND r.content <> e.content
          WHERE ('0x' || substr(e.h, 1, 8))::BIGINT % n = b OR place <= 64)
    SELECT doc_id, rank::INT AS rank, distractor FROM c WHERE rank <= 3""",
)
def distractor_self_join(spark, sf):
    """Whole texts of other sources, by their digests."""
    from gristmill.operators.distractors import from_other_groups

    return from_other_groups(docs(spark, sf).select("doc_id", "source", "content"), "doc_id", "source", "content", 3).withColumnRenamed("content", "distractor")


@query("label_vocabulary_distractors", """WITH v AS (SELECT DISTINCT p_type AS label FROM part), p AS (SELECT v.label, w.label AS other, len(list_intersect(string_split(v.label, ' '), string_split(w.label, ' '))) AS shared FROM v JOIN v w ON v.label <> w.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY shared DESC, sha256(label || ':' || other)) AS rank FROM p) SELECT label, other, shared::INT AS shared, rank::INT AS rank FROM r WHERE rank <= 3""")
def label_vocabulary_distractors(spark, sf):
    from gristmill.operators.distractors import from_vocabulary

    return from_vocabulary(table(spark, sf, "part").select(F.col("p_type").alias("label")), "label", 3)


@query("prefix_range_lookup", """WITH p AS (SELECT DISTINCT substr(regexp_extract(url, '^[a-z]+://[^/]+/'), 1, 8 + (page_id % 16)::INT) AS prefix FROM pages) SELECT page_id, prefix FROM pages JOIN p ON starts_with(url, prefix)""")
def prefix_range_lookup(spark, sf):
    from gristmill.operators.neardup import prefix_join

    pages = table(spark, sf, "pages").select("page_id", "url")
    host = F.regexp_extract("url", "^[a-z]+://[^/]+/", 0)
    prefixes = pages.select(F.substring(host, F.lit(1), (8 + F.col("page_id") % 16).cast("int")).alias("prefix")).distinct()
    return prefix_join(pages, "url", prefixes, "prefix").select("page_id", "prefix")


@query("dimension_lookups", """SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def dimension_lookups(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # 25 and 5 rows
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("message_shape", """SELECT conv_id, count(*) AS n, string_agg(role, '>' ORDER BY turn) AS roles, count(*) FILTER (WHERE role = 'assistant') AS answers FROM conversations GROUP BY conv_id""")
def message_shape(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("m"), F.count_if(F.col("role") == "assistant").alias("answers"))
    return c.select("conv_id", "n", F.array_join(F.transform("m", lambda s: s["role"]), ">").alias("roles"), "answers")
