"""Named queries of gates, audits, reports by tier and remaining split policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.hashing import digest, hash8
from gristmill.operators import leakage, metrics, review, splits
from gristmill.operators.graph import connected_components
from gristmill.sources.scans import table

from .evaluation import _AGG, _pair_sql, _scored_sql, _two, boot_sql, scored
from .queries import _B8, _MAIL, first_mail, query


@query("component_split", f"""WITH e AS (SELECT o_custkey, o_orderkey, o_custkey % 40 AS c FROM orders), s AS (SELECT c, {_B8.format("min(o_custkey)::VARCHAR", 100)} AS b FROM e GROUP BY c)
    SELECT CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' WHEN b < 95 THEN 'calibration' ELSE 'test' END AS split, count(*) AS n FROM e JOIN s USING (c) GROUP BY 1""")
def component_split(spark, sf):
    """Customers that share a residue are linked; a component goes to one split by the hash of its smallest."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 40).alias("c"))
    first = o.groupBy("c").agg(F.min("o_custkey").alias("low"))
    parts = connected_components(o.join(F.broadcast(first), "c").select("o_custkey", "low"), "o_custkey", "low")  # 40 residues
    split = splits.hashed("component", steps=((80, "train"), (90, "dev"), (95, "calibration")))
    return o.join(parts, o["o_custkey"] == parts["node"]).groupBy(split.alias("split")).agg(F.count("*").alias("n"))


@query("forced_split", """WITH n AS (SELECT p_brand || p_size AS fam, count(*) AS c FROM part GROUP BY 1) SELECT CASE WHEN c = 1 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM part JOIN n ON fam = p_brand || p_size GROUP BY 1""")
def forced_split(spark, sf):
    p = table(spark, sf, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("fam"), F.lit("train").alias("split"))
    return splits.forced(p, "fam", "test").groupBy("split").agg(F.count("*").alias("n"))


@query("review_gate", """WITH r AS (SELECT doc_id, quality, toxic, CASE WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS st FROM labels)
    SELECT CASE WHEN r.doc_id IS NULL THEN 'unreviewed' WHEN st <> 'approved' THEN 'not_approved' WHEN toxic = 1 THEN 'not_visible' WHEN lang <> 'en' THEN 'other_gold' ELSE 'approved' END AS status, count(*) AS n FROM documents d LEFT JOIN r USING (doc_id) GROUP BY 1""")
def review_gate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit("h").alias("media_sha256"), F.when(F.col("lang") == "en", "en").otherwise("xx").alias("gold"))
    r = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("review_status"), F.lit("someone").alias("reviewer"), (F.col("toxic") != 1).alias("visible"), F.lit("first").alias("frame_policy"), F.lit("h").alias("media_sha256"), F.lit("en").alias("gold_key"))
    return review.review_status(d, r, "doc_id", "gold", F.array(F.lit("en"), F.lit("xx")), "first").groupBy("status").agg(F.count("*").alias("n"))


@query("media_verification", """WITH r AS (SELECT l_orderkey AS k, max(l_returnflag) AS src FROM lineitem GROUP BY 1) SELECT CASE WHEN r.k IS NULL THEN 'missing' WHEN src = 'A' THEN 'other_source' WHEN o_orderkey % 7 = 0 THEN 'other_hash' ELSE 'ready' END AS status, count(*) AS n FROM orders LEFT JOIN r ON k = o_orderkey GROUP BY 1""")
def media_verification(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit("s").alias("src"), F.lit("h").alias("sha256"))
    records = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_returnflag").alias("f")).select("k", F.when(F.col("f") == "A", "t").otherwise("s").alias("src"), F.when(F.col("k") % 7 == 0, "x").otherwise("h").alias("sha256"))
    return review.verify_media(rows, records, "k", "src").groupBy("status").agg(F.count("*").alias("n"))


@query("feature_row_mismatch", """SELECT vec_id, CASE WHEN label <> vec_id % 10 THEN 'label' END AS columns FROM embeddings WHERE label <> vec_id % 10""")
def feature_row_mismatch(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").alias("size"))
    rows = e.select("vec_id", (F.col("vec_id") % 10).cast("int").alias("label"), F.lit(64).alias("size"))
    return review.metadata_mismatches(e, rows, "vec_id", ["label", "size"])


@query("view_ablation", """SELECT doc_id, v AS view, length(CASE v WHEN 'empty' THEN '' WHEN 'head' THEN substr(text, 1, 50) ELSE text END) AS chars, CASE v WHEN 'empty' THEN NULL ELSE lang END AS lang FROM documents, (VALUES ('full'), ('head'), ('empty')) t(v)""")
def view_ablation(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = review.views(d, {"full": {}, "head": {"text": F.substring("text", 1, 50)}, "empty": {"text": F.lit(""), "lang": F.lit(None)}})
    return out.select("doc_id", "view", F.length("text").alias("chars"), "lang")


@query("lexical_cues", r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\b(the|and)\b') AND NOT regexp_matches(text, '(?i)\b(license|licensed)\b')""")
def lexical_cues(spark, sf):
    return table(spark, sf, "documents").where(review.lexical(F.col("text"), ["the", "and"], ["license", "licensed"])).select("doc_id")


@query("placeholder_splits", "SELECT p_brand || p_size AS split, count(*) AS n FROM part GROUP BY 1 HAVING bool_and(substr(p_type, 1, 1) = 'S')")
def placeholder_splits(spark, sf):
    p = table(spark, sf, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("split"), F.substring("p_type", 1, 1).alias("c"))
    return review.placeholder_splits(p, "split", "c", "S")


@query("numeric_suffix_order", """WITH u AS (SELECT user_id, 'frame_' || (event_id % 1000) || '.jpg' AS name, event_id % 1000 AS k FROM events) SELECT user_id, string_agg(name, ',' ORDER BY k, name) AS frames FROM u GROUP BY 1""")
def numeric_suffix_order(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.concat(F.lit("frame_"), (F.col("event_id") % 1000).cast("string"), F.lit(".jpg"))).alias("names"))
    return e.select("user_id", F.array_join(review.numeric_order(F.col("names")), ",").alias("frames"))


@query("top_logits", f"""WITH {_scored_sql()}, l AS (SELECT o_orderkey, unnest(range(5)) AS i, unnest(z) AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, i) AS rank FROM l)
    SELECT o_orderkey, rank::INT AS rank, i::INT AS option, round(score, 9) AS score FROM r WHERE rank <= 3""")
def top_logits(spark, sf):
    s = scored(spark, sf).select("o_orderkey", F.posexplode(review.top_scores(F.col("z"), 3)).alias("rank", "t"))
    return s.select("o_orderkey", (F.col("rank") + 1).alias("rank"), F.col("t.i").alias("option"), F.round("t.score", 9).alias("score"))


@query("suite_report", f"""WITH {_scored_sql()}, x AS (SELECT *, o_orderkey % 3 AS suite FROM s), g AS (SELECT suite, o_orderstatus, avg(correct) AS m FROM x GROUP BY 1, 2), m AS (SELECT suite, round(avg(m), 6) AS macro FROM g GROUP BY 1)
    SELECT suite, {_AGG}, any_value(macro) AS macro, round((avg(correct) + 3.8416 / (2 * count(*)) - 1.96 * sqrt(avg(correct) * (1 - avg(correct)) / count(*) + 3.8416 / (4.0 * count(*) * count(*)))) / (1 + 3.8416 / count(*)), 6) AS low FROM x JOIN m USING (suite) GROUP BY suite""")
def suite_report(spark, sf):
    s = scored(spark, sf).withColumn("suite", F.col("o_orderkey") % 3)
    base = s.groupBy("suite").agg(*metrics.base_metrics(), F.avg("correct").alias("_p"), F.count("*").cast("double").alias("_n"))
    low, _ = metrics.wilson(F.col("_n"), F.col("_p") * F.col("_n"))
    return base.withColumn("low", F.round(low, 6)).join(metrics.macro(s, "o_orderstatus", ["suite"]).select("suite", "macro"), "suite").drop("_p", "_n")


@query("tiered_report", f"""WITH {_scored_sql()}, x AS (SELECT *, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS tier FROM s) SELECT tier, o_orderpriority, GROUPING(tier, o_orderpriority)::INT AS grouping_id, {_AGG} FROM x GROUP BY GROUPING SETS ((), (tier), (o_orderpriority))""")
def tiered_report(spark, sf):
    s = scored(spark, sf).withColumn("tier", F.when(F.col("o_totalprice") > 200000, "high").otherwise("low"))
    return metrics.grouping_sets(s, [[], ["tier"], ["o_orderpriority"]], metrics.base_metrics()).select("tier", "o_orderpriority", "grouping_id", "n", "correct", "accuracy", "log_loss", "brier")


@query("paired_bootstrap", f"""WITH {_pair_sql()}, {boot_sql('o_orderkey', 'sum(k * d)::DOUBLE / sum(k)')} SELECT count(*) AS resamples, round((list_sort(list(mean)))[51], 6) AS low, round((list_sort(list(mean)))[1950], 6) AS high FROM m""")
def paired_bootstrap(spark, sf):
    """Orders are the clusters, so single pairs are drawn; the bounds are the 51st and the 1,950th of 2,000 means."""
    wide = metrics.paired(_two(spark, sf), "o_orderkey", "model", "m1", "m2", [])
    return metrics.order_interval(metrics.cluster_bootstrap(wide, "o_orderkey"))


@query("candidate_selection", f"""WITH {_scored_sql()}, g AS (SELECT o_custkey % 20 AS candidate, round(avg(correct), 6) AS accuracy, round(avg(loss), 6) AS log_loss FROM s GROUP BY 1) SELECT candidate, accuracy, log_loss FROM g ORDER BY CASE WHEN accuracy >= 0.2 THEN 0 ELSE 1 END, accuracy DESC, log_loss, candidate LIMIT 1""")
def candidate_selection(spark, sf):
    g = scored(spark, sf).groupBy((F.col("o_custkey") % 20).alias("candidate")).agg(F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.avg("loss"), 6).alias("log_loss"))
    return review.select_candidate(g, F.col("accuracy") >= 0.2, [F.desc("accuracy"), F.col("log_loss"), F.col("candidate")])


@query("family_metrics", f"""WITH {_scored_sql()} SELECT o_orderstatus AS family, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(loss), 6) AS log_loss FROM s GROUP BY 1""")
def family_metrics(spark, sf):
    return scored(spark, sf).groupBy(F.col("o_orderstatus").alias("family")).agg(F.count("*").alias("n"), F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.avg("loss"), 6).alias("log_loss"))


@query("identity_overlap", f"""WITH k AS (SELECT doc_id, {_B8.format('doc_id::VARCHAR', 100)} < 80 AS train, source AS grp, sha256(text) AS content, nullif(regexp_extract(text, '{_MAIL}'), '') AS mail FROM documents)
    SELECT kind, count(*) AS keys FROM (SELECT 'content' AS kind, content AS key FROM k GROUP BY content HAVING bool_or(train) AND NOT bool_and(train) UNION ALL SELECT 'mail', mail FROM k WHERE mail IS NOT NULL GROUP BY mail HAVING bool_or(train) AND NOT bool_and(train) UNION ALL SELECT 'group', grp FROM k GROUP BY grp HAVING bool_or(train) AND NOT bool_and(train)) GROUP BY kind""")
def identity_overlap(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content"), first_mail().alias("mail"), splits.hashed("doc_id", steps=((80, "train"),), last="dev").alias("split"))
    keys = leakage.tagged_keys(d, "doc_id", {"content": F.col("content"), "mail": F.col("mail"), "group": F.col("source")}, "split")
    return keys.groupBy("kind", "key").agg(F.count_distinct("split").alias("s")).where("s > 1").groupBy("kind").agg(F.count("*").alias("keys"))


@query("hash_mod5_dev", f"SELECT source, count(*) FILTER (WHERE {_B8.format('doc_id::VARCHAR', 5)} = 0) AS dev, count(*) AS n FROM documents GROUP BY 1")
def hash_mod5_dev(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count_if(hash8(digest("doc_id")) % 5 == 0).alias("dev"), F.count("*").alias("n"))
