"""Named queries over predictions, boxes, codes, pages and streams; predictions are the hash-scored stub."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.hashing import synthetic_score
from gristmill.functions.vectors import dot, entropy_confidence, softmax
from gristmill.operators import decide, metrics, neardup, spatial
from gristmill.sources import scans, sinks
from gristmill.sources.scans import table

from .queries import _B8, _PR, priorities, query

# SQL of the stub's scores: z over the five priorities, p, pick, target, correct, loss, brier.
_Z = "list_transform({pr}, lambda k: ('0x' || substr(sha256('{m}' || o_orderkey || k), 1, 4))::INT / 65535.0::DOUBLE)"


def _scored_sql(model: str = "m1", extra: str = "") -> str:
    return f"""z AS (SELECT *, {_Z.format(pr=_PR, m=model)} AS z, substr(o_orderpriority, 1, 1)::INT - 1 AS target FROM orders),
    e AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS ex FROM z), q AS (SELECT *, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM e),
    s AS (SELECT *, list_position(z, list_max(z)) - 1 AS pick, CASE WHEN list_position(z, list_max(z)) - 1 = target THEN 1 ELSE 0 END AS correct, list_max(p) AS confidence, -ln(greatest(p[target + 1], 1e-12)) AS loss,
        list_sum(list_transform(range(1, 6), lambda i: pow(p[i] - CASE WHEN i - 1 = target THEN 1 ELSE 0 END, 2))) AS brier {extra} FROM q)"""


_AGG = "count(*) AS n, sum(correct)::BIGINT AS correct, round(avg(correct), 6) AS accuracy, round(avg(loss), 6) AS log_loss, round(avg(brier), 6) AS brier"


def orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").withColumn("target", F.substring("o_orderpriority", 1, 1).cast("int") - 1)


def scored(spark, sf, model: str = "m1") -> DataFrame:
    return metrics.scored(orders(spark, sf).withColumn("z", decide.stub_scores("o_orderkey", priorities(), model)), "z", "target")


@query("synthetic_scores", f"SELECT o_orderkey, i::INT AS option, round(z[i + 1], 9) AS score FROM (SELECT o_orderkey, {_Z.format(pr=_PR, m='m1')} AS z FROM orders), range(5) t(i)")
def synthetic_scores(spark, sf):
    o = orders(spark, sf).select("o_orderkey", F.posexplode(decide.stub_scores("o_orderkey", priorities(), "m1")).alias("option", "score"))
    return o.withColumn("score", F.round("score", 9))


@query("typed_answers", f"""WITH {_scored_sql()}, k AS (SELECT *, CASE o_orderkey % 2 WHEN 0 THEN 'choice' ELSE 'score' END AS kind FROM s)
    SELECT o_orderkey, kind, CASE WHEN kind = 'choice' THEN {_PR}[pick + 1] END AS choice, CASE WHEN kind = 'score' THEN round(list_sum(list_transform(range(1, 6), lambda i: p[i] * (i - 1))), 6) END AS value FROM k""")
def typed_answers(spark, sf):
    s = scored(spark, sf).withColumn("kind", F.when(F.col("o_orderkey") % 2 == 0, "choice").otherwise("score")).withColumn("keys", priorities())
    return decide.answers(s, "kind", "keys", "p").select("o_orderkey", "kind", "choice", "value")


_W = "CASE WHEN o_orderkey % 3 = 0 THEN [1.0::DOUBLE / 3, 2.0::DOUBLE / 3] ELSE list_transform(range(1, 6), lambda i: i / 15.0::DOUBLE) END"


@query("typed_requests", f"""WITH p AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS two, {_W} AS p FROM orders)
    SELECT o_orderkey::VARCHAR AS id, 'q' AS name, CASE WHEN two THEN 'noul' ELSE 'choice' END AS kind, CASE WHEN NOT two THEN '5-LOW' END AS choice, CASE WHEN two THEN round(p[2], 6) END AS value,
        round(1 + list_sum(list_transform(p, lambda x: x * ln(x))) / ln(len(p)), 6) AS confidence, len(p)::INT AS n, round(p[1], 6) AS p_first, round(p[len(p)], 6) AS p_last FROM p""")
def typed_requests(spark, sf):
    """The pandas scorer path: the weight of option i is i + 1."""
    o = table(spark, sf, "orders")
    options = F.transform(priorities(), lambda p: F.struct(p.alias("key"), F.lit(None).cast("string").alias("text")))
    requests = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("state"), F.lit("q").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, "noul").otherwise("choice").alias("kind"), F.lit("Which?").alias("instructions"), options.alias("options"))
    done = decide.evaluate(requests, lambda state, question, options: [i + 1 for i in range(len(options))])
    p = F.col("probabilities")
    return done.select("id", "name", "kind", "choice", "value", "confidence", F.size(p).alias("n"), F.round(F.element_at(p, 1), 6).alias("p_first"), F.round(F.element_at(p, -1), 6).alias("p_last"))


@query("entropy_confidence", f"""WITH {_scored_sql()} SELECT o_orderkey, round(greatest(0, least(1, 1 + list_sum(list_transform(p, lambda x: x * ln(x))) / ln(5))), 6) AS confidence FROM s""")
def entropy_conf(spark, sf):
    return scored(spark, sf).select("o_orderkey", F.round(entropy_confidence(F.col("p")), 6).alias("confidence"))


_SIX = "(), (broad), (modality), (family), (family, modality), (source)"


@query("metrics_grouping_sets", f"""WITH {_scored_sql()}, x AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'text' ELSE 'vision' END AS broad, o_orderstatus AS modality, o_orderpriority AS family, o_custkey % 7 AS source FROM s)
    SELECT broad, modality, family, source::VARCHAR AS source, GROUPING(broad, modality, family, source)::INT AS grouping_id, {_AGG} FROM x GROUP BY GROUPING SETS ({_SIX})""")
def metrics_grouping_sets(spark, sf):
    """Each row feeds six overlapping groups: all, text or vision, modality, family, both of these, and source."""
    s = scored(spark, sf).select("*", F.when(F.col("o_orderstatus") == "F", "text").otherwise("vision").alias("broad"), F.col("o_orderstatus").alias("modality"), F.col("o_orderpriority").alias("family"), (F.col("o_custkey") % 7).cast("string").alias("source"))
    sets = [[], ["broad"], ["modality"], ["family"], ["family", "modality"], ["source"]]
    return metrics.grouping_sets(s, sets, metrics.base_metrics(), ["broad", "modality", "family", "source"])


@query("macro_accuracy", f"""WITH {_scored_sql()}, g AS (SELECT o_orderstatus, o_orderpriority, avg(correct) AS m FROM s GROUP BY 1, 2) SELECT o_orderstatus, round(avg(m), 6) AS macro, count(*) AS groups FROM g GROUP BY 1""")
def macro_accuracy(spark, sf):
    return metrics.macro(scored(spark, sf), "o_orderpriority", ["o_orderstatus"])


@query("balanced_objective", f"""WITH {_scored_sql()}, a AS (SELECT avg(m) AS m FROM (SELECT avg(correct) AS m FROM s GROUP BY o_orderstatus)), b AS (SELECT avg(m) AS m FROM (SELECT avg(correct) AS m FROM s GROUP BY o_orderpriority)), c AS (SELECT avg(m) AS m FROM (SELECT avg(correct) AS m FROM s GROUP BY o_custkey % 7))
    SELECT round((round(a.m, 6) + round(b.m, 6) + round(c.m, 6)) / 3, 5) AS objective FROM a, b, c""")
def balanced_objective(spark, sf):
    s = scored(spark, sf).withColumn("c7", F.col("o_custkey") % 7)
    means = metrics.grouping_sets(s, [["o_orderstatus"], ["o_orderpriority"], ["c7"]], [F.avg("correct").alias("m")])
    return means.groupBy("grouping_id").agg(F.round(F.avg("m"), 6).alias("macro")).agg(F.round(F.sum("macro") / 3, 5).alias("objective"))


@query("brier_logloss_rps", f"""WITH {_scored_sql()}, r AS (SELECT *, list_sum(list_transform(range(1, 5), lambda i: pow(list_sum(p[1:i]) - CASE WHEN i - 1 >= target THEN 1 ELSE 0 END, 2))) / 4 AS rps, abs(list_sum(list_transform(range(1, 6), lambda i: p[i] * (i - 1))) - target) AS mae FROM s)
    SELECT round(avg(mae), 6) AS mae, round(avg(rps), 6) AS rps FROM r""")
def brier_logloss_rps(spark, sf):
    return metrics.ordinal(scored(spark, sf), "p", "target")


@query("reliability_bins", f"""WITH {_scored_sql()} SELECT o_orderstatus, least(4, floor(confidence * 5))::INT AS bin, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(correct), 6) AS accuracy FROM s GROUP BY 1, 2""")
def reliability_bins(spark, sf):
    return metrics.reliability(scored(spark, sf), ["o_orderstatus"], 5)


@query("ece10", f"""WITH {_scored_sql()}, b AS (SELECT o_orderstatus, least(9, floor(confidence * 10)) AS bin, count(*) AS n, avg(confidence) AS c, avg(correct) AS a FROM s GROUP BY 1, 2)
    SELECT o_orderstatus, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b GROUP BY 1""")
def ece10(spark, sf):
    return metrics.ece(scored(spark, sf), ["o_orderstatus"])


@query("wilson_ci", f"""WITH {_scored_sql()}, g AS (SELECT o_orderpriority, count(*)::DOUBLE AS n, sum(correct)::DOUBLE AS k FROM s GROUP BY 1)
    SELECT o_orderpriority, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low,
        round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM g""")
def wilson_ci(spark, sf):
    g = scored(spark, sf).groupBy("o_orderpriority").agg(F.count("*").cast("double").alias("n"), F.sum("correct").cast("double").alias("k"))
    low, high = metrics.wilson(F.col("n"), F.col("k"))
    return g.select("o_orderpriority", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("latency_percentiles", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    return metrics.quantiles(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("class_balance_median", """WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT min(n) AS least, (list_sort(list(n)))[len(list(n)) // 2 + 1] AS median, max(n) AS most, count(*) AS classes FROM c""")
def class_balance_median(spark, sf):
    c = table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return c.agg(F.min("n").alias("least"), metrics.upper_median("n").alias("median"), F.max("n").alias("most"), F.count("*").alias("classes"))


_GRID = "list_transform(range(161), lambda i: 0.25 * pow(pow(16.0, 1.0 / 160), i))"


def _fit_sql(source: str) -> str:
    return f"""g AS (SELECT s.o_orderkey, s.o_orderstatus, s.z, s.target, i, t FROM s, (SELECT unnest(range(161)) AS i, unnest({_GRID}) AS t) WHERE {source}),
    n AS (SELECT o_orderstatus, i, t, round(avg(-ln(greatest(exp((z[target + 1] - list_max(z)) / t) / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / t))), 1e-12))), 9) AS nll FROM g GROUP BY 1, 2, 3),
    f AS (SELECT o_orderstatus, min(struct_pack(nll := nll, i := i, t := t)) AS b FROM n GROUP BY 1)"""


@query("temperature_fit", f"""WITH {_scored_sql()}, {_fit_sql('s.o_orderkey % 4 = 0')} SELECT o_orderstatus, round(b.t, 6) AS temperature, round(b.nll, 6) AS nll, b.i IN (0, 160) AS at_boundary FROM f""")
def temperature_fit(spark, sf):
    return metrics.fit_temperature(scored(spark, sf).where("o_orderkey % 4 = 0"), ["o_orderstatus"], "z", "target", 5)


@query("calibration_report", f"""WITH {_scored_sql()}, {_fit_sql('s.o_orderkey % 4 = 0')}, x AS (SELECT s.*, b.t AS t FROM s JOIN f USING (o_orderstatus) WHERE s.o_orderkey % 4 <> 0)
    SELECT o_orderstatus, count(*) AS n, round(avg(loss), 6) AS before, round(avg(-ln(greatest(exp((z[target + 1] - list_max(z)) / round(t, 6)) / list_sum(list_transform(z, lambda y: exp((y - list_max(z)) / round(t, 6)))), 1e-12))), 6) AS after FROM x GROUP BY 1""")
def calibration_report(spark, sf):
    s = scored(spark, sf)
    t = metrics.fit_temperature(s.where("o_orderkey % 4 = 0"), ["o_orderstatus"], "z", "target", 5)
    rest = s.where("o_orderkey % 4 <> 0").join(t.select("o_orderstatus", "temperature"), "o_orderstatus")
    from gristmill.functions.vectors import log_loss

    return rest.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("before"), F.round(F.avg(log_loss(softmax(F.col("z"), F.col("temperature")), F.col("target"))), 6).alias("after"))


def _two(spark, sf) -> DataFrame:
    both = [scored(spark, sf, m).select("o_orderkey", "o_orderstatus", "o_custkey", F.lit(m).alias("model"), "correct") for m in ("m1", "m2")]
    return both[0].unionByName(both[1])


def _pair_sql() -> str:
    two = _Z.format(pr=_PR, m="m2")
    return f"""w0 AS (SELECT *, {_Z.format(pr=_PR, m='m1')} AS z1, {two} AS z2, substr(o_orderpriority, 1, 1)::INT AS target FROM orders),
    w AS (SELECT o_orderkey, o_orderstatus, o_custkey, CASE WHEN list_position(z1, list_max(z1)) = target THEN 1 ELSE 0 END AS a, CASE WHEN list_position(z2, list_max(z2)) = target THEN 1 ELSE 0 END AS b FROM w0)"""


@query("paired_model_delta", f"""WITH {_pair_sql()} SELECT o_orderstatus, count(*) AS n, round(avg(b - a), 6) AS delta, count(*) FILTER (WHERE b = 1 AND a = 0) AS gained, count(*) FILTER (WHERE a = 1 AND b = 0) AS lost FROM w GROUP BY 1""")
def paired_model_delta(spark, sf):
    return metrics.paired_delta(metrics.paired(_two(spark, sf), "o_orderkey", "model", "m1", "m2", ["o_orderstatus"]), ["o_orderstatus"])


def boot_sql(cluster: str, mean: str) -> str:
    """Means ``m`` of 2,000 resamples of the pairs ``w``: a digest of a cluster and j gives the draws 8 j to 8 j + 7."""
    return f"""c AS (SELECT {cluster} AS c, count(*) AS n, sum(b - a) AS d FROM w GROUP BY 1),
    h AS (SELECT j, n, d, sha256('boot:' || j || ':' || c) AS h FROM c, range(250) t(j)), u AS (SELECT j * 8 + x AS i, n, d, ('0x' || substr(h, (8 * x + 1)::INT, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM h, range(8) y(x)),
    r AS (SELECT i, n, d, {' + '.join(f'CASE WHEN u >= {p!r} THEN 1 ELSE 0 END' for p in metrics.POISSON)} AS k FROM u), m AS (SELECT i, {mean} AS mean FROM r GROUP BY 1)"""


@query("cluster_bootstrap", f"""WITH {_pair_sql()}, {boot_sql('o_custkey', 'sum(k * d)::DOUBLE / sum(k * n)')} SELECT count(*) AS resamples, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def cluster_bootstrap(spark, sf):
    wide = metrics.paired(_two(spark, sf), "o_orderkey", "model", "m1", "m2", ["o_custkey"])
    return metrics.interval(metrics.cluster_bootstrap(wide, "o_custkey"))


@query("order_balanced_logits", f"""WITH k AS (SELECT o_orderkey, unnest({_PR}) AS key FROM orders),
    m AS (SELECT o_orderkey, key, list_avg(list_transform(range(5), lambda r: ('0x' || substr(sha256('rot' || r || o_orderkey || key), 1, 4))::INT / 65535.0::DOUBLE)) AS mean FROM k),
    x AS (SELECT *, exp(mean - max(mean) OVER (PARTITION BY o_orderkey)) AS e FROM m) SELECT o_orderkey, key, round(mean, 6) AS mean, round(e / sum(e) OVER (PARTITION BY o_orderkey), 6) AS p FROM x""")
def order_balanced_logits(spark, sf):
    o = orders(spark, sf).select("o_orderkey", F.explode(priorities()).alias("key"))
    long = o.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("score", synthetic_score(F.lit("rot"), "r", "o_orderkey", "key"))
    return decide.order_balanced(long, ["o_orderkey"], "key", "score")


@query("prior_subtraction", f"""WITH z AS (SELECT o_orderkey, {_Z.format(pr=_PR, m='m1')} AS z, {_Z.format(pr=_PR, m='prior')} AS q FROM orders), w AS (SELECT *, unnest([0.0, 0.5, 1.0])::DOUBLE AS weight FROM z),
    d AS (SELECT *, list_transform(range(1, 6), lambda i: z[i] - weight * q[i]) AS y FROM w), e AS (SELECT *, list_transform(y, lambda x: exp(x - list_max(y))) AS ex FROM d)
    SELECT o_orderkey, weight, (list_position(y, list_max(y)) - 1)::INT AS pick, round(list_max(ex) / list_sum(ex), 6) AS confidence FROM e""")
def prior_subtraction(spark, sf):
    o = orders(spark, sf).select("o_orderkey", decide.stub_scores("o_orderkey", priorities(), "m1").alias("z"), decide.stub_scores("o_orderkey", priorities(), "prior").alias("q"))
    p = decide.minus_prior(o, "z", "q", [0.0, 0.5, 1.0])
    return p.select("o_orderkey", "weight", "pick", F.round(F.array_max("p"), 6).alias("confidence"))


@query("run_agreement", f"""WITH z AS (SELECT {_Z.format(pr=_PR, m='m1')} AS x, {_Z.format(pr=_PR, m='m2')} AS y FROM orders),
    p AS (SELECT list_transform(x, lambda v: exp(v - list_max(x)) / list_sum(list_transform(x, lambda u: exp(u - list_max(x))))) AS x, list_transform(y, lambda v: exp(v - list_max(y)) / list_sum(list_transform(y, lambda u: exp(u - list_max(y))))) AS y FROM z)
    SELECT count(*) AS n, count(*) FILTER (WHERE list_position(x, list_max(x)) = list_position(y, list_max(y))) AS same, round(max(list_max(list_transform(range(1, 6), lambda i: abs(x[i] - y[i])))), 6) AS largest_gap FROM p""")
def run_agreement(spark, sf):
    return decide.agreement(scored(spark, sf, "m1"), scored(spark, sf, "m2"), "o_orderkey")


@query("selection_gate", f"""WITH {_pair_sql()}, g AS (SELECT o_orderstatus, round(avg(a), 6) AS base, round(avg(b), 6) AS new FROM w GROUP BY 1) SELECT o_orderstatus, base, new, new >= base - 0.01 AS passed FROM g""")
def selection_gate(spark, sf):
    report = lambda m: scored(spark, sf, m).groupBy("o_orderstatus").agg(F.round(F.avg("correct"), 6).alias("accuracy"))
    return metrics.gates(report("m2"), report("m1"), ["o_orderstatus"], "accuracy", 0.01)


@query("metrics_disagreement", f"""WITH {_pair_sql()}, g AS (SELECT o_orderpriority, round(avg(a), 6) AS x, round(avg(b), 6) AS y FROM w JOIN orders USING (o_orderkey) GROUP BY 1) SELECT o_orderpriority FROM g WHERE abs(x - y) > 0.002""")
def metrics_disagreement(spark, sf):
    report = lambda m: scored(spark, sf, m).groupBy("o_orderpriority").agg(F.round(F.avg("correct"), 6).alias("accuracy"))
    return metrics.metrics_agree(report("m1"), report("m2"), ["o_orderpriority"], ["accuracy"], 0.002)


@query("gold_position_histogram", f"SELECT o_orderstatus, list_position({_PR}, o_orderpriority)::INT - 1 AS position, count(*) AS n FROM orders GROUP BY 1, 2")
def gold_position_histogram(spark, sf):
    return orders(spark, sf).groupBy("o_orderstatus", F.col("target").alias("position")).agg(F.count("*").alias("n"))


@query("majority_slot_baseline", "WITH h AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT round(max(n) / sum(n), 6) AS baseline, sum(n)::BIGINT AS n FROM h")
def majority_slot_baseline(spark, sf):
    h = orders(spark, sf).groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return h.agg(F.round(F.max("n") / F.sum("n"), 6).alias("baseline"), F.sum("n").alias("n"))


@query("inventory_long", """SELECT 'documents' AS dataset, lang AS slice, unnest(['rows', 'chars', 'sources']) AS counter, unnest([count(*), sum(n_chars)::BIGINT, count(DISTINCT source)]) AS n FROM documents GROUP BY lang
    UNION ALL SELECT 'orders', o_orderstatus, unnest(['rows', 'chars', 'sources']), unnest([count(*), sum(length(o_orderpriority))::BIGINT, count(DISTINCT o_custkey)]) FROM orders GROUP BY o_orderstatus""")
def inventory_long(spark, sf):
    def one(df, name, slice_, chars, source):
        g = df.groupBy(F.lit(name).alias("dataset"), F.col(slice_).alias("slice")).agg(F.count("*").alias("rows"), F.sum(chars).cast("long").alias("chars"), F.count_distinct(source).alias("sources"))
        return g.unpivot(["dataset", "slice"], ["rows", "chars", "sources"], "counter", "n")

    return one(table(spark, sf, "documents"), "documents", "lang", F.col("n_chars"), "source").unionByName(one(table(spark, sf, "orders"), "orders", "o_orderstatus", F.length("o_orderpriority"), "o_custkey"))


@query("status_rollup", """SELECT lang, count(*) AS expected, count(l.doc_id) AS ready, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang""")
def status_rollup(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id").distinct().withColumn("_done", F.lit(1))
    return d.join(l, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("expected"), F.count("_done").alias("ready"), F.count_if(F.col("_done").isNull()).alias("missing"))


@query("split_pivot", f"""WITH d AS (SELECT lang, CASE WHEN {_B8.format("doc_id::VARCHAR", 100)} < 80 THEN 'train' ELSE 'dev' END AS split FROM documents) SELECT lang, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'dev') AS dev FROM d GROUP BY 1""")
def split_pivot(spark, sf):
    from gristmill.operators.splits import hashed

    d = table(spark, sf, "documents").select("lang", hashed("doc_id", steps=((80, "train"),), last="dev").alias("split"))
    return d.groupBy("lang").pivot("split", ["train", "dev"]).agg(F.count(F.lit(1))).select("lang", F.coalesce("train", F.lit(0)).alias("train"), F.coalesce("dev", F.lit(0)).alias("dev"))


@query("group_counters", """SELECT l_orderkey AS grp, count(*) AS elements, count(*) FILTER (WHERE l_returnflag = 'R') AS targets, bool_or(l_linestatus = 'O') AS any_open FROM lineitem GROUP BY 1""")
def group_counters(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("grp")).agg(F.count("*").alias("elements"), F.count_if(F.col("l_returnflag") == "R").alias("targets"), F.bool_or(F.col("l_linestatus") == "O").alias("any_open"))


@query("storage_estimate", "SELECT label, count(*) AS n, sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings GROUP BY label")
def storage_estimate(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("embedding") * 4).alias("bytes"))


@query("weighted_loss", f"""WITH {_scored_sql()}, c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS tot, count(*) AS k FROM c), w AS (SELECT o_orderstatus, sqrt(tot / (k * n)) AS weight FROM c, t)
    SELECT round(sum(weight * loss) / sum(weight), 6) AS loss FROM s JOIN w USING (o_orderstatus)""")
def weighted_loss(spark, sf):
    from gristmill.operators.sampling import sqrt_inverse_weights

    s = scored(spark, sf).select("o_orderstatus", "loss")
    w = sqrt_inverse_weights(table(spark, sf, "orders").select("o_orderstatus"), "o_orderstatus")
    return s.join(w, "o_orderstatus").agg(F.round(F.sum(F.col("weight") * F.col("loss")) / F.sum("weight"), 6).alias("loss"))


# Codes, vectors and boxes.

# Bit i of the code is the sign of the sum of the dimensions i, i + 20, i + 40 and so on, so all 64 count.
_CODE = "list_sum(list_transform(range(1, 21), lambda i: CASE WHEN embedding[i]::DOUBLE + embedding[i + 20]::DOUBLE + embedding[i + 40]::DOUBLE + coalesce(embedding[i + 60], 0)::DOUBLE > 0 THEN (1::BIGINT << (i - 1)) ELSE 0 END))::BIGINT"
_PAIRS = f"c AS (SELECT vec_id, {_CODE} AS code FROM embeddings), p AS (SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.code, y.code))::INT AS distance FROM c x JOIN c y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.code, y.code)) <= 2)"


def _codes(spark, sf) -> DataFrame:
    at = lambda i: F.coalesce(F.get("embedding", i).cast("double"), F.lit(0.0))
    folded = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: at(i) + at(i + 20) + at(i + 40) + at(i + 60))
    return table(spark, sf, "embeddings").select("vec_id", neardup.sign_code(folded, 20).alias("code"))


@query("hamming_near_dup_pairs", f"WITH {_PAIRS} SELECT a, b, distance FROM p")
def hamming_near_dup_pairs(spark, sf):
    return neardup.hamming_pairs(_codes(spark, sf), "vec_id", "code", 20, 2)


@query("near_dup_components", f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p), r(node, low) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.node WHERE r.low < e.y)
    SELECT node, min(low) AS component FROM r GROUP BY node""")
def near_dup_components(spark, sf):
    return neardup.components(_codes(spark, sf), "vec_id", "code", 20, 2)


@query("label_similarity_argmax", """WITH q AS (SELECT label AS k, list_transform(range(1, 65), lambda i: 1) AS one, min_by(embedding, vec_id) AS e FROM embeddings GROUP BY label), s AS (SELECT vec_id, k, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * e[i])), 5) AS score FROM embeddings, q)
    SELECT vec_id, arg_min(k, struct_pack(a := -score, b := k)) AS best FROM s GROUP BY vec_id""")
def label_similarity_argmax(spark, sf):
    e = table(spark, sf, "embeddings")
    each = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    if each.count() > 4096:
        raise ValueError("labels are compared with every row, so there may be 4,096 at most")
    anchors = each.agg(F.collect_list(F.struct("label", "anchor")).alias("anchors"))  # one vector a label
    scored_ = F.transform("anchors", lambda s: F.struct((-F.round(dot(F.col("embedding"), s["anchor"]), 5)).alias("score"), s["label"].alias("label")))
    return e.crossJoin(F.broadcast(anchors)).select("vec_id", F.array_min(scored_)["label"].alias("best"))


_BOX = "SELECT l_orderkey AS grp, l_linenumber AS element, min(l_returnflag) AS role, min(l_quantity) AS l, l_linenumber * 5.0::DOUBLE AS t, 1 + min(l_discount) * 100 AS w, 1 + min(l_tax) * 100 AS h FROM lineitem GROUP BY 1, 2"
_NEG = f"""b AS ({_BOX}), g AS (SELECT grp, role AS tr, l AS tl, t AS tt, w AS tw, h AS th FROM b WHERE element = 1),
    d AS (SELECT b.*, tr, round(pow(l + w / 2 - (tl + tw / 2), 2) + pow(t + h / 2 - (tt + th / 2), 2), 6) AS distance FROM b JOIN g USING (grp) WHERE element <> 1)"""


def _boxes(spark, sf) -> DataFrame:
    # Line numbers repeat in an order here, so equal ones are one element.
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("element")).agg(F.min("l_returnflag").alias("role"), F.min("l_quantity").alias("l"), F.min("l_discount").alias("d"), F.min("l_tax").alias("x"))
    return l.select("grp", "element", "role", "l", (F.col("element") * 5.0).alias("t"), (1 + F.col("d") * 100).alias("w"), (1 + F.col("x") * 100).alias("h"))


@query("nearest_negatives", f"""WITH {_NEG}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN role <> tr THEN 1 ELSE 0 END, distance, element) AS rank FROM d) SELECT grp, element, rank::INT AS rank, distance FROM r WHERE rank <= 3""")
def nearest_negatives(spark, sf):
    return spatial.nearest_negatives(_boxes(spark, sf), "grp", F.col("element") == 1, 3).select("grp", "element", "rank", "distance")


def _iou_sql(a: str, b: str) -> str:
    """Overlap of two boxes as SQL, each given by a prefix of its columns or fields."""
    w = f"greatest(0.0, least({a}l + {a}w, {b}l + {b}w) - greatest({a}l, {b}l))"
    h = f"greatest(0.0, least({a}t + {a}h, {b}t + {b}h) - greatest({a}t, {b}t))"
    return f"coalesce(({w}) * ({h}) / nullif({a}w * {a}h + {b}w * {b}h - ({w}) * ({h}), 0), 0.0)"


# A fold: each step takes the next element of a group's queue if it is clear of those taken before.
@query(
    "greedy_iou_options",
    f"""WITH RECURSIVE {_NEG.replace("b.*, tr,", "b.*, tr, tl, tt, tw, th,")},
    q AS (SELECT grp, {{'element': element, 'l': l, 't': t, 'w': w, 'h': h}} AS e,
                 row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN role <> tr THEN 1 ELSE 0 END, distance, element) AS i
          FROM d WHERE {_iou_sql("", "t")} < 0.1),
    s AS (SELECT grp, 1 AS i, [e] AS taken FROM q WHERE i = 1
          UNION ALL
          SELECT grp, q.i, CASE WHEN len(taken) < 3 AND len(list_filter(taken, lambda o: {_iou_sql("q.e.", "o.")} >= 0.1)) = 0 THEN list_append(taken, q.e) ELSE taken END
          FROM s JOIN q USING (grp) WHERE q.i = s.i + 1),
    z AS (SELECT grp, taken FROM s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY i DESC) = 1)
    SELECT grp, unnest(list_transform(taken, lambda o: o.element)) AS element, unnest(range(1, len(taken) + 1)) AS place FROM z""",
)
def greedy_iou_options(spark, sf):
    return spatial.greedy_distinct(_boxes(spark, sf), "grp", F.col("element") == 1, 3)


@query("point_in_box", f"""WITH b AS ({_BOX}), g AS (SELECT grp, l + w / 2 AS x, t + h / 2 AS y FROM b WHERE element = 1), j AS (SELECT b.*, x BETWEEN l AND l + w AND y BETWEEN t AND t + h AS hit, row_number() OVER (PARTITION BY grp ORDER BY element) AS r FROM b JOIN g USING (grp) WHERE element <> 1)
    SELECT grp, bool_or(hit) AS any_hit, coalesce(bool_or(hit AND r <= 3), false) AS top_hit FROM j GROUP BY grp""")
def point_in_box(spark, sf):
    return spatial.point_coverage(_boxes(spark, sf), "grp", F.col("element") == 1, 3)


# Pages, manifests and streams.


@query("html_controls")
def html_controls(spark, sf):
    return scans.html_controls(table(spark, sf, "pages"), "page_id", "html")


@query("tree_nodes", r"""WITH l AS (SELECT page_id, unnest(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10))) AS line, generate_subscripts(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)), 1) - 1 AS line_no FROM pages)
    SELECT page_id, line_no::INT AS line_no, length(regexp_extract(line, '^(\s*)<(\w+)', 1))::INT AS depth, regexp_extract(line, '^(\s*)<(\w+)', 2) AS role FROM l WHERE regexp_matches(line, '^(\s*)<(\w+)')""")
def tree_nodes(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.replace("html", F.lit("><"), F.lit(">\n<")).alias("html"))
    return scans.tree_nodes(pages, "page_id", "html", r"^(\s*)<(\w+)()().*$").select("page_id", "line_no", "depth", F.col("node").alias("role"))


@query("manifest_digest", "SELECT r_name AS split, count(*) AS n, sha256(string_agg(n_nationkey || ':' || n_name, chr(10) ORDER BY n_nationkey)) AS sha256 FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def manifest_digest(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    named = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).withColumnRenamed("r_name", "split")
    return sinks.manifest(named, "split", "n_nationkey", F.concat_ws(":", F.col("n_nationkey").cast("string"), "n_name"))


@query("availablenow_incremental", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def availablenow_incremental(spark, sf):
    from gristmill.streaming.incremental import read_new, run_available

    path = f"{sf}/events.parquet"
    # A file stream wants a folder or a glob; the brackets make a single file a glob.
    stream = read_new(spark, path[:-1] + "[t]", spark.read.parquet(path).schema).dropDuplicates(["event_id"])
    return run_available(stream, spark).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("windowed_stream", "SELECT date_trunc('day', ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def windowed_stream(spark, sf):
    from gristmill.streaming.incremental import read_new, run_available, windowed_counts

    path = f"{sf}/events.parquet"
    stream = read_new(spark, path[:-1] + "[t]", spark.read.parquet(path).schema)
    done = run_available(windowed_counts(stream, "ts", ["event_type"]), spark, "complete")
    return done.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")
