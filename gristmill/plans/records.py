"""Named queries that put the driver's tables through the converters of raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import texts
from gristmill.operators import leakage, review, sampling, splits, typed, validation
from gristmill.sources import converters as C
from gristmill.sources.scans import table

from .evaluation import _scored_sql, scored
from .queries import _LADDER, priorities, query

_LEVELS = "['lowest', 'low', 'middle', 'high', 'highest']"


def _source(name: str) -> C.Source:
    return C.Source(name, f"driver/{name}", "1")


def _brief(rows: DataFrame) -> DataFrame:
    """Row, split, kind of question, number of options and text of the gold option (no options and no text where there is a reason)."""
    text = F.get(F.filter("question.options", lambda o: o["key"] == F.col("gold.key")), F.lit(0))["text"]
    when = lambda c: F.when(F.col("reason").isNull(), c)
    return rows.select(F.col("source.row").alias("row"), "split", when(F.col("question.type")).alias("kind"), F.coalesce(when(F.size("question.options")), F.lit(0)).cast("long").alias("n_options"), when(text).alias("gold_text"), "reason")


def _mod(text: str, n: int) -> str:
    """SQL of the whole digest of a text modulo n."""
    return f"list_reduce(list_transform(string_split(sha256({text}), ''), lambda c: ('0x' || c)::INT), lambda a, c: (a * 16 + c) % {n}, 0)"


def _split(name: str, group: str, official: str = "NULL") -> str:
    hashed = _LADDER.format(_mod(f"'pilot:{name}:' || {group}", 100))
    return f"CASE {official} WHEN 'test' THEN 'test' WHEN 'validation' THEN 'calibration' ELSE {hashed} END"


def _sql(body: str, row: str, split: str, kind: str, n: str, gold: str, reason: str) -> str:
    """The brief of a converter; ``body`` gives the table ``x``."""
    return f"""WITH {body}, y AS (SELECT *, {reason} AS reason FROM x) SELECT {row} AS row, {split} AS split, CASE WHEN reason IS NULL THEN {kind} END AS kind, CASE WHEN reason IS NULL THEN ({n})::BIGINT ELSE 0 END AS n_options, CASE WHEN reason IS NULL THEN {gold} END AS gold_text, reason FROM y"""


_OFFICIAL = "CASE o_orderstatus WHEN 'F' THEN 'test' WHEN 'P' THEN 'validation' ELSE 'train' END"


def _orders(spark, sf) -> DataFrame:
    official = F.when(F.col("o_orderstatus") == "F", "test").when(F.col("o_orderstatus") == "P", "validation").otherwise("train")
    return table(spark, sf, "orders").select("*", F.col("o_orderkey").alias("index"), official.alias("split"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("level"))


@query("convert_match_events", _sql("x AS (SELECT *, CASE event_type WHEN 'click' THEN 'Goal' WHEN 'view' THEN 'Yellow card' WHEN 'purchase' THEN 'Red card' END AS t FROM events)", "event_id::VARCHAR", _split("events", "strftime(ts, '%Y-%m-%d') || ':' || user_id || ':' || event_type"), "'choice'", "3", "t", "CASE WHEN t IS NULL THEN 'other_event' END"))
def convert_match_events(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("click", "goal", "view", "yellow_card", "purchase", "red_card")])
    e = table(spark, sf, "events").select(F.col("event_id").alias("asset_id"), F.coalesce(names[F.col("event_type")], "event_type").alias("event_category"), F.date_format("ts", "yyyy-MM-dd").alias("game_date"), F.col("user_id").cast("string").alias("home_team"), F.col("event_type").alias("away_team"), F.concat(F.col("event_id").cast("string"), F.lit(".mp4")).alias("mp4_file"))
    return _brief(C.match_events(e, _source("events")))


@query("convert_shot_captions", _sql("x AS (SELECT *, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS v, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 1 END AS p, l_linestatus = 'O' AS made, l_linenumber % 5 <> 0 AS one FROM lineitem)", "v", _split("shots", "l_orderkey"), f"CASE WHEN {_mod(chr(39) + 'pilot:shots:' + chr(39) + ' || v', 3)} = 0 THEN 'score' ELSE 'noul' END", f"CASE WHEN {_mod(chr(39) + 'pilot:shots:' + chr(39) + ' || v', 3)} = 0 THEN 4 ELSE 2 END", f"CASE WHEN {_mod(chr(39) + 'pilot:shots:' + chr(39) + ' || v', 3)} = 0 THEN ['none', 'one', 'two', 'three'][1 + CASE WHEN made THEN p ELSE 0 END] ELSE made::VARCHAR END", "CASE WHEN NOT one THEN 'not_one_shot' END"))
def convert_shot_captions(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "2PT Shot").when(F.col("l_returnflag") == "N", "3PT Shot").otherwise("Free Throw")
    said = F.concat(F.lit("A player made a "), kind, F.lit(" which result was "), F.when(F.col("l_linestatus") == "O", "made").otherwise("miss"), F.lit(". "))
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    l = table(spark, sf, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("video"), F.array(turn("human", said), turn("gpt", F.when(F.col("l_linenumber") % 5 == 0, F.concat(said, said)).otherwise(said))).alias("conversations"))
    return _brief(C.shot_captions(l, _source("shots")))


@query("convert_driving", _sql(f"x AS (SELECT *, {_OFFICIAL} AS split, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE 'maybe' END AS a, {_mod(chr(39) + 'pilot:driving:' + chr(39) + f' || ({_OFFICIAL}) || ' + chr(39) + ':' + chr(39) + ' || o_orderkey', 3)} <> 0 AS bin FROM orders)", "split || ':' || o_orderkey", f"CASE split WHEN 'test' THEN 'test' WHEN 'validation' THEN 'test' ELSE {_LADDER.format(_mod(chr(39) + 'pilot:driving:' + chr(39) + ' || o_custkey', 100))} END", "CASE WHEN bin THEN 'noul' ELSE 'choice' END", "2", "CASE WHEN bin THEN (a = 'yes')::VARCHAR ELSE upper(a[1]) || a[2:] END", "CASE WHEN a = 'maybe' THEN 'answer' WHEN o_orderkey % 11 = 0 THEN 'blank_question' END"))
def convert_driving(spark, sf):
    answer = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "no ").otherwise("maybe")
    o = _orders(spark, sf).select("index", "split", F.when(F.col("o_orderkey") % 11 == 0, "  ").otherwise(F.concat_ws(" ", F.lit("Is order"), "o_orderkey", F.lit("done?"))).alias("question"), answer.alias("ground_truth_answer"), F.col("o_custkey").alias("scene_id"), F.lit("").alias("situation"), F.lit("").alias("time_span"))
    return _brief(C.driving(o, _source("driving")))


@query("convert_counting", _sql(f"x AS (SELECT *, o_orderkey % 18 AS n, {_OFFICIAL} AS split, o_orderkey % 18 <= 9 AND {_mod(chr(39) + 'pilot:counting:' + chr(39) + f' || ({_OFFICIAL}) || ' + chr(39) + ':' + chr(39) + ' || o_orderkey', 2)} = 1 AS s FROM orders)", "split || ':' || o_orderkey", _split("counting", "o_custkey", "split"), "CASE WHEN s THEN 'score' ELSE 'choice' END", "CASE WHEN s THEN 10 ELSE 4 END", "n::VARCHAR", "CASE WHEN n > 15 THEN 'count' WHEN o_orderkey % 13 = 0 THEN 'no_image' END"))
def convert_counting(spark, sf):
    o = _orders(spark, sf).select("index", "split", (F.col("o_orderkey") % 18).cast("int").alias("count"), F.lit("boxes").alias("label"), F.when(F.col("o_orderkey") % 13 == 0, "").otherwise("u").alias("image_url"), F.col("o_custkey").cast("string").alias("image_sha256"))
    return _brief(C.counting(o, _source("counting")))


@query("convert_nli", _sql(f"x AS (SELECT *, o_orderkey % 4 AS l, {_OFFICIAL} AS split, {_mod(chr(39) + 'pilot:nli:' + chr(39) + f' || ({_OFFICIAL}) || ' + chr(39) + ':' + chr(39) + ' || o_orderkey', 3)} = 0 AS bin FROM orders)", "split || ':' || o_orderkey", _split("nli", "o_custkey", "split"), "CASE WHEN bin THEN 'noul' ELSE 'choice' END", "CASE WHEN bin THEN 2 ELSE 3 END", "CASE WHEN bin THEN (l = 0)::VARCHAR ELSE ['Entails', 'Neither', 'Contradicts'][l + 1] END", "CASE WHEN l = 3 THEN 'label' END"))
def convert_nli(spark, sf):
    o = _orders(spark, sf).select("index", "split", F.col("o_custkey").cast("string").alias("premise"), F.col("o_orderpriority").alias("hypothesis"), (F.col("o_orderkey") % 4).cast("int").alias("label"))
    return _brief(C.nli(o, _source("nli")))


@query("convert_sentiment", _sql(f"x AS (SELECT *, o_orderkey % 6 AS l, {_OFFICIAL} AS split FROM orders)", "split || ':' || o_orderkey", _split("sentiment", "o_orderpriority || o_custkey", "split"), "'score'", "5", "['very negative', 'negative', 'neutral', 'positive', 'very positive'][l + 1]", "CASE WHEN l = 5 THEN 'label' END"))
def convert_sentiment(spark, sf):
    o = _orders(spark, sf).select("index", "split", F.concat("o_orderpriority", F.col("o_custkey").cast("string")).alias("text"), (F.col("o_orderkey") % 6).cast("int").alias("label"))
    return _brief(C.sentiment(o, _source("sentiment")))


@query("convert_answerability", _sql("c AS (SELECT conv_id, turn, role, text, 'Q ' || turn AS q FROM conversations), x AS (SELECT * FROM c)", "conv_id || '/' || turn || '/' || role", _split("answers", "conv_id"), "'noul'", "2", "(role = 'assistant')::VARCHAR", "CASE WHEN role = 'system' THEN 'blank_question' WHEN length('Question: ' || q || chr(10) || 'Passage: ' || text) > 6000 THEN 'too_long' END"))
def convert_answerability(spark, sf):
    said = F.when(F.col("role") == "assistant", F.array("text")).otherwise(F.array().cast("array<string>"))
    c = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn", "role").alias("id"), F.lit("train").alias("split"), F.col("conv_id").cast("string").alias("title"), F.col("text").alias("context"), F.when(F.col("role") == "system", " ").otherwise(F.concat_ws(" ", F.lit("Q"), "turn")).alias("question"), F.struct(said.alias("text")).alias("answers"))
    return _brief(C.answerability(c, _source("answers")))


@query("convert_ratings", _sql(f"r AS (SELECT *, {_OFFICIAL} AS split, {_mod(chr(39) + 'pilot:ratings:r' + chr(39) + ' || o_orderkey', 2)} AS pick FROM orders), x AS (SELECT *, CASE pick WHEN 0 THEN o_orderkey % 6 ELSE substr(o_orderpriority, 1, 1)::INT - 1 END AS l FROM r)", "split || ':' || o_orderkey", _split("ratings", "o_custkey", "split"), "'score'", "5", f"{_LEVELS}[l + 1]", "CASE WHEN l > 4 THEN 'rating' END"))
def convert_ratings(spark, sf):
    o = _orders(spark, sf).select("index", "split", F.col("o_custkey").cast("string").alias("prompt"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("response"), (F.col("o_orderkey") % 6).alias("clear"), F.col("level").alias("urgent"))
    levels = ["lowest", "low", "middle", "high", "highest"]
    return _brief(C.ratings(o, _source("ratings"), {"clear": levels, "urgent": levels}))


@query("convert_choice_qa", _sql("p AS (SELECT *, list_transform(string_split(p_name, ' '), lambda v: trim(v)) AS v, p_size % 4 AS a FROM part), x AS (SELECT *, list_transform(v, lambda t: lower(t)) AS t FROM p)", "'train:' || p_partkey", _split("science", "p_brand", "'train'"), "'choice'", "len(v)", "v[a + 1]", "CASE WHEN p_size % 10 = 0 THEN 'unlabeled' WHEN len(v) < 2 OR len(v) > 10 OR list_contains(t, '') OR len(list_distinct(t)) < len(t) OR a >= len(v) THEN 'invalid_choices_or_answer' END"))
def convert_choice_qa(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("index"), F.lit("train").alias("split"), F.concat_ws(" ", F.lit("Which word of"), "p_name").alias("question"), F.split("p_name", " ").alias("choices"), F.when(F.col("p_size") % 10 != 0, (F.col("p_size") % 4).cast("int")).alias("answer"), F.when(F.col("p_size") % 3 == 0, "i.png").alias("image"), F.col("p_brand").alias("question_id"), F.lit(None).cast("string").alias("hint"))
    return _brief(C.choice_qa(p, _source("science"), "word_choice"))


@query("convert_labelled_images", _sql(f"x AS (SELECT *, {_OFFICIAL} AS split, o_orderkey % 7 AS l FROM orders)", "split || ':' || o_orderkey", _split("images", "split || ':' || o_orderkey", "split"), "'choice'", "4", "['a', 'b', 'c', 'd', 'e', 'f'][l + 1]", "CASE WHEN l > 5 THEN 'label' END"))
def convert_labelled_images(spark, sf):
    o = _orders(spark, sf).select("index", "split", F.lit("i.png").alias("image"), (F.col("o_orderkey") % 7).cast("int").alias("label"))
    return _brief(C.labelled_images(o, _source("images"), list("abcdef"), {"a": "vowel", "e": "vowel"}))


@query("convert_video_classes", _sql("x AS (SELECT *, 'v_' || o_orderpriority || '_g' || lpad((o_custkey % 25)::VARCHAR, 2, '0') || '_c01.avi' AS name FROM orders)", "'train:' || o_orderkey", _split("videos", "o_orderpriority || ':' || lpad((o_custkey % 25)::VARCHAR, 2, '0')", "'train'"), "'choice'", "3", "o_orderpriority", "CASE WHEN o_orderpriority = '5-LOW' THEN 'other_class' END"))
def convert_video_classes(spark, sf):
    name = F.concat(F.lit("v_"), "o_orderpriority", F.lit("_g"), F.lpad((F.col("o_custkey") % 25).cast("string"), 2, "0"), F.lit("_c01.avi"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"), F.lit("train").alias("split"), F.concat_ws("/", F.lit("videos"), "o_orderpriority", name).alias("video_path"))
    return _brief(C.video_classes(o, _source("videos"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], 3))


@query("convert_sports_qa", _sql("x AS (SELECT *, [p_brand, p_type, p_name] AS w FROM part)", "p_partkey::VARCHAR", _split("sports", "CASE p_size % 4 WHEN 0 THEN p_partkey::VARCHAR WHEN 3 THEN '../m.jpg' ELSE 'm' || p_size || CASE p_size % 4 WHEN 1 THEN '.jpg' ELSE '.mp4' END END", "'train'"), "'choice'", "CASE WHEN p_size % 5 = 0 THEN 2 ELSE 3 END", "w[1 + p_partkey % 3]", "CASE WHEN p_size % 5 = 0 AND p_partkey % 3 = 2 THEN 'answer_key_absent' WHEN p_size % 4 = 3 THEN 'unsafe_path' END"))
def convert_sports_qa(spark, sf):
    paths = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 4 == 3, F.array(F.lit("../m.jpg"))).otherwise(F.array(F.concat(F.lit("m"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 4 == 1, ".jpg").otherwise(".mp4"))))
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("train").alias("split"), F.lit("Which?").alias("Q"), F.concat(F.lit("O"), (F.col("p_partkey") % 3 + 1).cast("string")).alias("closeA"), F.col("p_brand").alias("O1"), F.col("p_type").alias("O2"), F.when(F.col("p_size") % 5 == 0, "None").otherwise(F.col("p_name")).alias("O3"), paths.alias("materials"), F.col("p_brand").alias("task"))
    return _brief(C.sports_qa(p, _source("sports"), ["O1", "O2", "O3"]))


@query("tool_call_parse", _sql("c AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS tools, max_by(event_type, struct_pack(a := ts, b := event_id)) AS called FROM events WHERE event_type <> 'error' GROUP BY 1), x AS (SELECT *, CASE user_id % 9 WHEN 1 THEN 'unheard' ELSE called END AS said FROM c)", "user_id::VARCHAR", _split("tools", "user_id"), "'choice'", "len(tools)", "said", "CASE WHEN len(tools) < 2 THEN 'too_few_tools' WHEN user_id % 9 = 2 THEN 'no_image' WHEN user_id % 9 = 3 THEN 'blank' WHEN user_id % 9 = 1 THEN 'unknown_tool' END"))
def tool_call_parse(spark, sf):
    calls = table(spark, sf, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("tools"), F.max_by("event_type", F.struct("ts", "event_id")).alias("called"))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    asked = F.when(F.col("user_id") % 9 == 3, "<image>").otherwise("<image> what next?")
    said = F.concat(F.lit("{'name': '"), F.when(F.col("user_id") % 9 == 1, "unheard").otherwise(F.col("called")), F.lit("'}"))
    raw = calls.select(F.col("user_id").alias("index"), F.col("user_id").alias("id"), F.array(turn("user", asked), turn("function_call", said)).alias("messages"), F.to_json(F.transform("tools", lambda t: F.struct(t.alias("name")))).alias("tools"), (F.col("user_id") % 9 != 2).alias("has_image"))
    return _brief(C.tool_calls(raw, _source("tools")))


@query("convert_intents", _sql("i AS (SELECT count(DISTINCT p_type) AS v FROM part), x AS (SELECT part.*, v, replace(p_type, ' ', '_') AS c FROM part, i)", "'train:' || p_partkey", _split("intents", "p_name", "'train'"), "'choice'", f"least(v, CASE WHEN {_mod(chr(39) + 'pilot:intents:width:train:' + chr(39) + ' || p_partkey', 5)} = 0 THEN 8 ELSE 4 END)", "c", "CASE WHEN trim(p_name) = '' THEN 'blank' END"))
def convert_intents(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("index"), F.lit("train").alias("split"), F.col("p_name").alias("text"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("category"))
    return _brief(C.intents(p, _source("intents")))


@query("convert_segment_captions", _sql("x AS (SELECT *, 'caption of order ' || (o_orderkey % 4000) AS t FROM orders)", "o_orderkey::VARCHAR", _split("segments", "'r' || (o_custkey % 500)"), "'choice'", "4", "t", "CASE WHEN o_orderstatus = 'P' THEN 'licence' WHEN o_orderkey % 10 = 0 THEN 'no_event' END"))
def convert_segment_captions(spark, sf):
    event = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.concat_ws(" ", F.lit("caption of order"), F.col("o_orderkey") % 4000).alias("text"))
    events = F.when(F.col("o_orderkey") % 10 == 0, F.array(event(0.0, 20.0), event(28.0, 33.0))).otherwise(F.array(event(0.0, 20.0), event(2.0, 9.0)))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"), F.concat(F.lit("r"), (F.col("o_custkey") % 500).cast("string")).alias("identifier"), F.when(F.col("o_orderstatus") == "P", "https://example.org/by").otherwise("https://example.org/publicdomain/zero").alias("licenseurl"), F.lit("v.mp4").alias("video_url"), F.lit(0.0).alias("chunk_start"), F.lit(30.0).alias("chunk_end"), events.alias("events"))
    return _brief(C.segment_captions(o, _source("segments")))


# Which elements are the nearest does not show in the brief rows, but how many there are of another name does.
@query(
    "convert_interface_actions",
    """WITH e AS (SELECT l_orderkey AS key, l_linenumber AS element, l_returnflag AS role, l_returnflag || ' ' || l_partkey AS name, l_quantity AS l FROM lineitem),
    t AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY element, role, name, l) = 1),
    n AS (SELECT t.key, t.name, 1 + least(3, count(DISTINCT e.name) FILTER (WHERE e.element <> t.element AND lower(e.name) <> lower(t.name))) AS n
          FROM t JOIN e USING (key) GROUP BY 1, 2)
    SELECT key::VARCHAR AS row, CASE WHEN ('0x' || substr(sha256((key % 100)::VARCHAR), 1, 8))::BIGINT % 100 < 20 THEN 'dev' ELSE 'train' END AS split,
           CASE WHEN n > 1 THEN 'choice' END AS kind, CASE WHEN n > 1 THEN n ELSE 0 END AS n_options,
           CASE WHEN n > 1 THEN name END AS gold_text, CASE WHEN n < 2 THEN 'no_negatives' END AS reason FROM n""",
)
def convert_interface_actions(spark, sf):
    """Lines of an order are the elements of a screen; the first line is the target."""
    element = F.struct(F.col("l_linenumber").alias("element"), F.col("l_returnflag").alias("role"), F.concat_ws(" ", "l_returnflag", "l_partkey").alias("name"), F.col("l_quantity").alias("l"), (F.col("l_linenumber") * 5.0).alias("t"), (1 + F.col("l_discount") * 100).alias("w"), (1 + F.col("l_tax") * 100).alias("h"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(element)).alias("elements"))
    raw = lines.select(F.col("l_orderkey").alias("key"), (F.col("l_orderkey") % 100).alias("group"), F.lit("order the parts").alias("task"), F.transform("elements", lambda e: e["name"]).alias("history"), F.get("elements", F.lit(0)).alias("target"), "elements")
    return _brief(C.interface_actions(raw, _source("screens")))


_AGE = _mod("'age:' || event_id", 240)
_ABSENT = _mod("'pilot:queues:train:' || q", 5)


@query(
    "convert_message_queues",
    f"""WITH r AS (SELECT event_id, event_type, row_number() OVER (ORDER BY sha256('pilot:' || event_id), event_id) - 1 AS r FROM events),
    m AS (SELECT r // 4 AS q, event_type AS intent, {_AGE} + 1 AS age, row_number() OVER (PARTITION BY r // 4 ORDER BY sha256('order:' || event_id)) AS i FROM r WHERE r < 2000),
    g AS (SELECT q, list(intent ORDER BY i) AS mine FROM m GROUP BY q HAVING count(*) = 4),
    n AS (SELECT *, lead(mine) OVER (ORDER BY q) AS following FROM g),
    f AS (SELECT q, mine, list_filter(following, lambda x: NOT list_contains(mine, x))[1] AS foreign_intent FROM n),
    w AS (SELECT q, CASE WHEN foreign_intent IS NOT NULL AND {_ABSENT} = 0 THEN foreign_intent ELSE mine[1] END AS wanted FROM f),
    o AS (SELECT w.q, i FROM w LEFT JOIN m ON m.q = w.q AND m.intent = wanted QUALIFY row_number() OVER (PARTITION BY w.q ORDER BY age DESC, i) = 1)
    SELECT 'train:' || q AS row, 'train' AS split, 'choice' AS kind, 5::BIGINT AS n_options, 'Take ' || coalesce('message_' || i, 'none') AS gold_text, NULL::VARCHAR AS reason FROM o""",
)
def convert_message_queues(spark, sf):
    raw = table(spark, sf, "events").select(F.lit("train").alias("split"), F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", "event_id").alias("text"), F.col("event_type").alias("intent"))
    return _brief(C.message_queues(raw, _source("queues"), 500))


@query("option_priorities_reason", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'too_few_options' WHEN o_orderkey % 5 = 1 THEN 'duplicate_option' WHEN o_orderkey % 5 = 2 THEN 'blank_option' END AS reason FROM orders")
def option_priorities_reason(spark, sf):
    kind = F.col("o_orderkey") % 5
    options = F.when(kind == 0, F.slice(priorities(), 1, 1)).when(kind == 1, F.concat(priorities(), F.array(F.lit(" 1-urgent ")))).when(kind == 2, F.concat(priorities(), F.array(F.lit(" ")))).otherwise(priorities())
    return table(spark, sf, "orders").select("o_orderkey", validation.options_reason(options).alias("reason"))


# Rules on records, labels and selections.

_NAMES = "['train', 'validation', 'dev', 'test_main', 'validation_extra']"


@query("publisher_split", f"""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'books' WHEN 1 THEN 'chats' WHEN 2 THEN 'forms' ELSE 'mails' END AS source, {_NAMES}[1 + CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 3 % 5 ELSE 0 END] AS original, o_custkey AS g FROM orders),
    b AS (SELECT *, ('0x' || substr(sha256(source || g), 1, 8))::BIGINT % 100 AS b FROM o)
    SELECT o_orderkey, CASE WHEN source IN ('books', 'forms') AND original = 'validation' THEN 'test' WHEN original IN ('validation', 'dev') THEN 'dev' WHEN original LIKE 'test%' OR original LIKE 'validation!_%' ESCAPE '!' THEN 'test' WHEN b >= 95 THEN 'calibration' WHEN b >= 90 THEN 'dev' ELSE 'train' END AS split FROM b""")
def publisher_split(spark, sf):
    names = F.array(*[F.lit(x) for x in ("train", "validation", "dev", "test_main", "validation_extra")])
    source = F.get(F.array(*[F.lit(x) for x in ("books", "chats", "forms", "mails")]), (F.col("o_orderkey") % 4).cast("int"))
    original = F.get(names, F.when(F.col("o_orderkey") % 3 == 0, F.floor(F.col("o_orderkey") / 3) % 5).otherwise(0).cast("int"))
    o = table(spark, sf, "orders").select("o_orderkey", source.alias("s"), original.alias("o"), F.col("o_custkey").alias("g"))
    return o.select("o_orderkey", splits.publisher_split(F.col("s"), F.col("o"), F.col("g"), {"books": "validation", "forms": "validation"}).alias("split"))


@query("eligibility", """WITH o AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN [p_name] WHEN p_size % 10 = 1 THEN [p_name, upper(p_name) || ' '] ELSE [p_name, p_type, p_brand] END AS v, len(string_split(p_name, ' ')) * 300 AS tokens, p_partkey % 11 AS n, p_partkey % 12 <> 5 AS there, p_partkey % 13 = 0 AS sound FROM part)
    SELECT p_partkey, CASE WHEN len(v) < 2 THEN 'candidate_count' WHEN tokens > 600 THEN 'text_token_budget' WHEN p_partkey % 3 <> 0 AND n NOT BETWEEN 1 AND 8 THEN 'unsupported_media_count' WHEN n > 0 AND NOT there THEN 'missing_media' WHEN n > 0 AND sound THEN 'unsupported_media_kind' WHEN len(list_distinct(list_transform(v, lambda x: lower(trim(x))))) < 2 THEN 'invalid_candidates' END AS reason FROM o""")
def eligibility(spark, sf):
    options = F.when(F.col("p_size") % 10 == 0, F.array("p_name")).when(F.col("p_size") % 10 == 1, F.array("p_name", F.concat(F.upper("p_name"), F.lit(" ")))).otherwise(F.array("p_name", "p_type", "p_brand"))
    assets = F.array_repeat(F.when(F.col("p_partkey") % 13 == 0, "sound").otherwise("image"), (F.col("p_partkey") % 11).cast("int"))
    kind, modality = F.lit("choice"), F.when(F.col("p_partkey") % 3 == 0, "text").otherwise("image")
    why = validation.eligibility(kind, options, F.size(F.split("p_name", " ")) * 300, modality, assets, F.col("p_partkey") % 12 != 5, budget=600)
    return table(spark, sf, "part").select("p_partkey", why.alias("reason"))


@query("media_rules", """SELECT l_returnflag, CASE WHEN b NOT BETWEEN 1 AND 20000000 THEN 'bytes' WHEN w NOT BETWEEN 32 AND 8192 THEN 'dimensions' WHEN s <= 0 THEN 'duration' ELSE 'ok' END AS reason, count(*) AS n FROM (SELECT l_returnflag, (l_extendedprice * 250)::BIGINT AS b, l_partkey * 7 AS w, CASE WHEN l_linenumber > 2 THEN l_linenumber - 3 END AS s FROM lineitem) GROUP BY 1, 2""")
def media_rules(spark, sf):
    l = table(spark, sf, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 250).cast("long").alias("b"), (F.col("l_partkey") * 7).alias("w"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber") - 3).alias("s"))
    why = validation.media_reason(F.col("b"), F.col("w"), F.lit(480), F.col("s"))
    return l.groupBy("l_returnflag", F.coalesce(why, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("path_rules", """WITH p AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '/abs/' WHEN 1 THEN '../up/' WHEN 2 THEN 'c:\\' WHEN 3 THEN 'a/../b/' ELSE 'data/' END || o_orderkey || ['.JPG', '.mp4', '.wav', '.txt'][1 + o_orderkey % 4] AS path FROM orders)
    SELECT o_orderkey, o_orderkey % 6 > 3 AS safe, CASE o_orderkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' END AS kind FROM p""")
def path_rules(spark, sf):
    at = (F.col("o_orderkey") % 6).cast("int")
    head = F.coalesce(F.get(F.array(*[F.lit(x) for x in ("/abs/", "../up/", "c:\\", "a/../b/")]), at), F.lit("data/"))
    tail = F.get(F.array(*[F.lit(x) for x in (".JPG", ".mp4", ".wav", ".txt")]), (F.col("o_orderkey") % 4).cast("int"))
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(head, F.col("o_orderkey").cast("string"), tail).alias("path"))
    return o.select("o_orderkey", validation.safe_path(F.col("path")).alias("safe"), validation.media_kind(F.col("path")).alias("kind"))


@query("probability_rules", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'wrong_size' WHEN 1 THEN 'out_of_range' WHEN 2 THEN 'sum_not_one' END AS reason, CASE o_orderkey % 5 WHEN 0 THEN 'missing_key' WHEN 1 THEN 'not_finite' WHEN 2 THEN 'extra_key' WHEN 3 THEN 'missing' END AS problem FROM orders""")
def probability_rules(spark, sf):
    m = F.col("o_orderkey") % 5
    p = F.when(m == 0, F.array(F.lit(1.0))).when(m == 1, F.array(F.lit(1.5), F.lit(-0.5))).when(m == 2, F.array(F.lit(0.5), F.lit(0.4))).otherwise(F.array(F.lit(0.25), F.lit(0.75)))
    a, b, c = (F.lit(x) for x in "ABC")
    scores = F.when(m == 0, F.create_map(a, F.lit(1.0))).when(m == 1, F.create_map(a, F.lit(1.0), b, F.lit(float("nan")))).when(m == 2, F.create_map(a, F.lit(1.0), b, F.lit(1.0), c, F.lit(1.0))).when(m == 4, F.create_map(b, F.lit(1.0), a, F.lit(2.0)))
    return table(spark, sf, "orders").select("o_orderkey", validation.probabilities_reason(p, F.lit(2)).alias("reason"), validation.prediction_problems(F.array(a, b), scores).alias("problem"))


@query("display_labels", r"""WITH l AS (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'YoYo' WHEN 1 THEN 'TaiChi' ELSE 'Make' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || c_nationkey || 'Shot' END AS label FROM customer)
    SELECT c_custkey, CASE label WHEN 'YoYo' THEN 'Yo-Yo' WHEN 'TaiChi' THEN 'Tai Chi' ELSE regexp_replace(label, '([a-z0-9])([A-Z])', '\1 \2', 'g') END AS name FROM l""")
def display_labels(spark, sf):
    label = F.when(F.col("c_custkey") % 9 == 0, "YoYo").when(F.col("c_custkey") % 9 == 1, "TaiChi").otherwise(F.concat(F.lit("Make"), F.upper(F.substring("c_mktsegment", 1, 1)), F.lower(F.substring("c_mktsegment", 2, 99)), F.col("c_nationkey").cast("string"), F.lit("Shot")))
    return table(spark, sf, "customer").select("c_custkey", texts.display_label(label).alias("name"))


def _jaccard(a: str, b: str) -> str:
    words = [f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9_]+'))" for x in (a, b)]
    return f"len(list_intersect({words[0]}, {words[1]}))::DOUBLE / greatest(1, len(list_distinct(list_concat({words[0]}, {words[1]}))))"


@query("option_likeness", f"""WITH o AS (SELECT o_orderkey, o_orderpriority AS a, o_orderpriority || ' of ' || o_orderstatus AS b, 'of ' || o_custkey || ' ' || o_orderstatus AS c FROM orders)
    SELECT o_orderkey, round(greatest({_jaccard('a', 'b')}, {_jaccard('a', 'c')}, {_jaccard('b', 'c')}) + 0.03, 9) AS likeness FROM o""")
def option_likeness(spark, sf):
    options = F.array("o_orderpriority", F.concat_ws(" ", "o_orderpriority", F.lit("of"), "o_orderstatus"), F.concat_ws(" ", F.lit("of"), "o_custkey", "o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(texts.likeness(options), 9).alias("likeness"))


@query("common_prefixes", """WITH t AS (SELECT conv_id, list(string_split(text, ' ') ORDER BY turn, role) AS a FROM conversations GROUP BY 1), m AS (SELECT *, list_min(list_transform(a, lambda x: len(x))) AS least FROM t)
    SELECT conv_id, coalesce(list_min(list_filter(range(least), lambda i: len(list_distinct(list_transform(a, lambda x: x[i + 1]))) > 1)), least)::INT AS shared FROM m""")
def common_prefixes(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.split("text", " ", -1)).alias("a"))
    return c.select("conv_id", texts.common_prefix(F.col("a")).alias("shared"))


@query("most_common_sources", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def most_common_sources(spark, sf):
    return sampling.most_common(table(spark, sf, "documents"), "source", 5)


@query("replay_mix", """WITH b AS (SELECT doc_id, lang FROM documents WHERE lang = 'en'), n AS (SELECT floor(0.5 * count(*))::BIGINT AS n FROM b),
    p AS (SELECT doc_id, lang, row_number() OVER (ORDER BY sha256('replay:3:' || doc_id), doc_id) AS r FROM documents WHERE lang <> 'en'), a AS (SELECT doc_id, lang FROM b UNION ALL SELECT doc_id, lang FROM p, n WHERE r <= n)
    SELECT doc_id, lang, sha256('epoch:3:' || doc_id) AS turn FROM a""")
def replay_mix(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.replay(d.where("lang = 'en'"), d.where("lang <> 'en'"), 0.5, 3, "doc_id")


@query("united_sources", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def united_sources(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    parts = [o.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    return leakage.united(parts, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("ordered_labels", """WITH p AS (SELECT conv_id, list_transform(list(text ORDER BY turn, role), lambda t: trim(lower(string_split(t, ' ')[1]))) AS v FROM conversations GROUP BY 1), f AS (SELECT conv_id, list_filter(v, lambda x: x <> '') AS v FROM p)
    SELECT conv_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i)[1:255], ',') AS labels FROM f""")
def ordered_labels(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return c.select("conv_id", F.array_join(review.answer_labels(F.transform("m", lambda m: F.lower(F.get(F.split(m["text"], " "), F.lit(0))))), ",").alias("labels"))


@query("selection_size", "SELECT count(*) AS n FROM documents JOIN labels USING (doc_id)")
def selection_size(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", splits.hashed("doc_id", steps=((80, "train"),), last="dev").alias("split")).join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    return validation.selection_gate(d, "split", "lang", "doc_id", {"train": 20, "dev": 5}, ["en"]).select("n")


@query("declared_licences", """SELECT p_brand || '/' || p_size AS repo, CASE WHEN p_size % 3 = 0 THEN 'licence' ELSE 'label_map' END AS reason FROM part GROUP BY p_brand, p_size HAVING p_size % 3 = 0 OR p_size % 5 = 1""")
def declared_licences(spark, sf):
    p = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("repo"), "p_size").distinct()
    catalog = p.select("repo", F.when(F.col("p_size") % 3 == 0, "unknown").otherwise(" CC0-1.0").alias("licence"), F.when(F.col("p_size") % 5 == 1, "a,c").otherwise("a,b").alias("label_map"))
    return validation.declared(catalog, ["cc0-1.0", "mit"], p.select("repo", F.lit("a,b").alias("label_map")))


@query("message_prompts", """SELECT o_orderkey, 'Answer by letter.' || '|' || o_orderstatus || chr(10) || 'Which?' || chr(10) || 'A. 1-URGENT' || chr(10) || 'B. 2-HIGH' || chr(10) || 'C. 3-MEDIUM' || chr(10) || 'D. 4-NOT SPECIFIED' || chr(10) || 'E. 5-LOW' AS said FROM orders""")
def message_prompts(spark, sf):
    options, _ = typed.choice(priorities(), F.lit("5-LOW"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", options.alias("o"))
    said = typed.messages("Answer by letter.", F.col("o_orderstatus"), F.lit("Which?"), F.col("o"))
    return o.select("o_orderkey", F.array_join(F.transform(said, lambda m: m["content"]), "|").alias("said"))


@query("balanced_tasks", """WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256(event_id::VARCHAR)) AS rn FROM events) SELECT event_id, event_type FROM r WHERE rn <= 100""")
def balanced_tasks(spark, sf):
    from gristmill.functions.hashing import digest

    return sampling.balanced(table(spark, sf, "events").select("event_id", "event_type"), "event_type", 100, [digest("event_id")], "event_id")


@query("visible_targets", """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity * 30 AS x, 10 + l_discount * 1000 AS w, 10 + l_tax * 1000 AS h FROM lineitem), g AS (SELECT l_orderkey, min(struct_pack(n := l_linenumber, x := x, w := w, h := h)) AS t, max(w * h) AS most FROM l GROUP BY 1)
    SELECT l_orderkey, t.x + t.w / 2 <= 1200 AND t.h / 2 <= 600 AND most <= 0.01 * 1200 * 600 AS seen FROM g""")
def visible_targets(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), (F.col("l_quantity") * 30).alias("x"), (10 + F.col("l_discount") * 1000).alias("w"), (10 + F.col("l_tax") * 1000).alias("h")).alias("b"))
    g = l.groupBy("l_orderkey").agg(F.min("b").alias("t"), F.collect_list("b").alias("all"))
    box = {"l": F.col("t.x"), "t": F.lit(0.0), "w": F.col("t.w"), "h": F.col("t.h")}
    return g.select("l_orderkey", validation.visible(box, F.col("all"), F.lit(1200), F.lit(600), 0.01).alias("seen"))


@query("weight_problems", """SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'missing' WHEN vec_id % 11 = 0 THEN 'not_finite' WHEN vec_id % 13 = 0 THEN 'other_size' END AS reason FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0""")
def weight_problems(spark, sf):
    e = table(spark, sf, "embeddings")
    values = F.when(F.col("vec_id") % 11 == 0, F.array(F.lit(float("nan")))).otherwise(F.col("embedding").cast("array<double>"))
    reported = e.select("vec_id", F.when(F.col("vec_id") % 11 == 0, 1).when(F.col("vec_id") % 13 == 0, 3).otherwise(F.size("embedding")).alias("size"))
    return review.weight_problems(e.where("vec_id % 7 <> 0").select("vec_id", values.alias("v")), "vec_id", "v", reported)


@query("view_head_counts", f"""WITH {_scored_sql()}, v AS (SELECT o_orderkey % 3 AS view, 'one' AS head, correct FROM s UNION ALL SELECT o_orderkey % 3, 'zero', CASE WHEN target = 0 THEN 1 ELSE 0 END FROM s)
    SELECT view, head, count(*) AS n, sum(correct)::BIGINT AS correct, round(avg(correct), 6) AS accuracy FROM v GROUP BY 1, 2""")
def view_head_counts(spark, sf):
    s = scored(spark, sf)
    view = (F.col("o_orderkey") % 3).alias("view")
    heads = s.select(view, F.lit("one").alias("head"), "correct").unionByName(s.select(view, F.lit("zero").alias("head"), (F.col("target") == 0).cast("int").alias("correct")))
    return review.view_counts(heads, "view", "head", "correct")


@query("stream_suite_diagnostics", f"""WITH {_scored_sql()}, x AS (SELECT *, o_orderkey % 2 AS stream, o_custkey % 3 AS suite FROM s), b AS (SELECT stream, suite, least(9, floor(confidence * 10)) AS bin, count(*) AS n, avg(confidence) AS c, avg(correct) AS a FROM x GROUP BY 1, 2, 3), i AS (SELECT stream, suite, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b GROUP BY 1, 2)
    SELECT stream, suite, count(*) AS n, sum(correct)::BIGINT AS correct, round(avg(correct), 6) AS accuracy, round(avg(loss), 6) AS log_loss, round(avg(brier), 6) AS brier, any_value(ece) AS ece FROM x JOIN i USING (stream, suite) GROUP BY 1, 2""")
def stream_suite_diagnostics(spark, sf):
    from gristmill.operators import metrics

    s = scored(spark, sf).select("*", (F.col("o_orderkey") % 2).alias("stream"), (F.col("o_custkey") % 3).alias("suite"))
    return s.groupBy("stream", "suite").agg(*metrics.base_metrics()).join(metrics.ece(s, ["stream", "suite"]), ["stream", "suite"])


@query("source_probe", """SELECT unnest(['doc_id', 'quality', 'toxic']) AS "column", count(*) AS n, unnest([count(*) - count(doc_id), count(*) - count(quality), count(*) - count(toxic)]) AS nulls FROM labels""")
def source_probe(spark, sf):
    from gristmill.sources.scans import probe

    return probe(table(spark, sf, "labels").select("doc_id", "quality", "toxic")).select("column", "n", "nulls")
