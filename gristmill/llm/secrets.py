"""Secret scans by corpus-wide ownership frequency, in DataFrame operations only.

Every document is scanned once for candidates; only offsets, lengths and 64-bit value hashes leave the scan.
Value hashes are aggregated over distinct repositories and owners. A value of one owner in at most
``LIVE_REPOS`` of its repositories is *live* (owner-specific), one of at least ``COPIED_OWNERS`` owners or
``COPIED_REPOS`` repositories is *copied* (a widely copied example), others are *shared*. Base candidates (assign, access, hex) stay whatever their verdict. Bare tokens, which carry no key
word, become spans only if they are live and overlap no base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.skew import spread_join

from .common import fresh, stable
from .line_dedup import text_mark

COPIED_OWNERS, COPIED_REPOS, LIVE_REPOS = 3, 12, 3
# The patterns of each kind, in the order that breaks ties of equal starts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
BARE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[a-z0-9_-]*[A-Z])(?=[A-Z0-9_-]*[a-z])[A-Za-z0-9_-]{20,}"
KINDS = ["assign", "access", "hex", "bare"]
_LEAST = {"assign": 8, "access": 16, "hex": 32, "bare": 20}
_GUARD = {"assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "access": r"AKIA", "hex": HEX, "bare": BARE}
_PATTERN = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "bare": BARE}
_NONE = "array<struct<kind:int,i:int,gap:int,len:int,vlen:int,value:bigint>>"


def _found(text: Column, kind: str) -> Column:
    """Matches of one kind in order: lengths of the gap before and of the match, length and hash of the value.

    Gaps come from splitting the text by the same pattern, so offsets need no position from the regex engine.
    """
    pattern = F.lit(_PATTERN[kind])
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(1)) if kind == "assign" else whole
    zipped = F.arrays_zip(whole.alias("m"), value.alias("v"), F.split(text, _PATTERN[kind], -1).alias("g"))
    rows = F.transform(
        F.filter(zipped, lambda z: z["m"].isNotNull()),
        lambda z, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("len"), F.length(z["v"]).alias("vlen"), F.xxhash64(z["v"]).alias("value")),
    )
    return F.when(text.rlike(_GUARD[kind]), rows.cast(_NONE)).otherwise(F.array().cast(_NONE))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row per document and candidate (one with null ``kind`` where a document has none).

    ``uid, doc_id, mark, repo, owner, kind, start, end, value``; ``uid`` numbers the rows of ``docs``. Offsets
    are in code points, the end is exclusive. Candidates that are too short are already dropped.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    text = F.coalesce(F.col("_text"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.col(text_col).alias("_text"))
    scanned = slim.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text_mark(F.col("_text")).alias("mark"), "repo", "owner", F.concat(*[_found(text, k) for k in KINDS]).alias("found"))
    rows = stable(scanned).select("uid", "doc_id", "mark", "repo", "owner", F.explode_outer("found").alias("f")).select("uid", "doc_id", "mark", "repo", "owner", "f.*")
    before = F.sum(F.col("gap") + F.col("len")).over(_by_match())
    placed = rows.withColumn("end", before.cast("long")).withColumn("start", F.col("end") - F.col("len"))
    least = F.element_at(F.array(*[F.lit(_LEAST[k]) for k in KINDS]), F.col("kind") + 1)
    short = F.col("kind").isNotNull() & (F.col("vlen") < least)
    # A document whose only candidates are short must still give a row.
    return placed.select("uid", "doc_id", "mark", "repo", "owner", *[F.when(~F.coalesce(short, F.lit(False)), F.col(c)).alias(c) for c in ("kind", "start", "end", "value")])


def _by_match():
    from pyspark.sql import Window

    return Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)


def verdicts(found: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS, live_repos: int = LIVE_REPOS) -> DataFrame:
    """``value, rows, repos, owners, verdict`` of every candidate value, over the whole corpus.

    The distinct counts aggregate partially before they shuffle, so a value that a third of all rows hold
    reaches a task as few rows.
    """
    seen = found.where("kind IS NOT NULL").groupBy("value", "repo", "owner").agg(F.count("*").alias("rows"))
    counts = seen.groupBy("value").agg(F.sum("rows").alias("rows"), F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))
    copied = (F.col("owners") >= copied_owners) | (F.col("repos") >= copied_repos)
    verdict = F.when(copied, "copied").when((F.col("owners") == 1) & (F.col("repos") <= live_repos), "live").otherwise("shared")
    return counts.withColumn("verdict", verdict)


def scan(docs: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS, live_repos: int = LIVE_REPOS, **columns) -> DataFrame:
    """One row per document: counts of each kind and verdict, and its spans.

    ``doc_id, mark, n_assign, n_access, n_hex, n_bare, n_live, n_copied, repos, owners, base, all`` where ``base``
    and ``all`` are arrays of ``start, kind, end, verdict`` by start, then by kind as in ``KINDS``, and ``repos``
    and ``owners`` are the largest numbers of those that hold one of the document's values (0 without any).

    Defined cases: a null text is empty and has no spans; null sources count as one owner; rows that repeat
    are scanned each; texts of any length are scanned whole; candidates that start together come in the order of
    ``KINDS``; an empty table gives no rows; other columns are ignored.
    """
    found = stable(candidates(docs, **columns))
    judged = stable(verdicts(found, copied_owners, copied_repos, live_repos))
    # Only rows with a value are joined; documents without one would all meet under the null key.
    some = spread_join(found.where("kind IS NOT NULL"), judged, "value", "rows", judged.agg(F.sum("rows")).first()[0] or 0)
    fields = ["uid", "doc_id", "mark", "kind", "start", "end", "repos", "owners", "verdict"]
    none = found.where("kind IS NULL").select("uid", "doc_id", "mark", "kind", "start", "end", F.lit(0).cast("long").alias("repos"), F.lit(0).cast("long").alias("owners"), F.lit(None).cast("string").alias("verdict"))
    judged = some.select(*fields).unionByName(none)
    span = F.struct("start", "kind", "end", "verdict")
    wanted = F.col("kind").isNotNull() & ((F.col("kind") < 3) | (F.col("verdict") == "live"))
    per_doc = judged.groupBy("uid", "doc_id", "mark").agg(F.sort_array(F.collect_list(F.when(wanted, span))).alias("spans"), F.max("repos").alias("repos"), F.max("owners").alias("owners"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    split = per_doc.withColumn("base", base)
    free = F.filter("spans", lambda s: (s["kind"] < 3) | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    kept = split.withColumn("all", F.when(F.size("base") == F.size("spans"), F.col("spans")).otherwise(free))
    count = lambda field, value: F.size(F.filter("all", lambda s: s[field] == value)).cast("long")
    kinds = [count("kind", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    verdict = [count("verdict", v).alias(f"n_{v}") for v in ("live", "copied")]
    return kept.select("doc_id", "mark", *kinds, *verdict, "repos", "owners", "base", "all")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_bare, n_live, n_copied, repos, owners`` (see ``scan``)."""
    found = scan(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), "n_bare", "n_live", "n_copied", "repos", "owners")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """``docs`` with every span replaced: ``[EXAMPLE_KEY]`` for copied values, ``[SECRET]`` for all others.

    Defined cases: spans that overlap are replaced together; rows without findings come back as they were, null and
    empty texts too; rows that repeat are all redacted; texts of any length are redacted whole; all other columns come back
    under their names, whatever these are; an empty table stays empty. Only the findings are joined, by id and a
    mark of the text.
    """
    mark, own, hit, spans = fresh(docs, "mark", "own", "hit", "spans")
    hits = scan(docs, id_col=id_col, text_col=text_col, **columns).where(F.size("all") > 0).groupBy("doc_id", "mark").agg(F.first("all").alias(spans))
    hits = hits.select(F.col("doc_id").alias(own), F.col("mark").alias(hit), spans)
    marked = docs.withColumn(mark, text_mark(F.col(text_col)))
    both = marked.join(hits, F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(mark) == F.col(hit)), "left")
    text = F.col(text_col)
    # State: code point after the last replaced one, and the pieces so far. A span inside that is passed over.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        label = F.when(s["verdict"] == "copied", F.lit("[EXAMPLE_KEY]")).otherwise(F.lit("[SECRET]"))
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece, label)).alias("out"))
        joined = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(joined)

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return both.withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(done)).drop(own, hit, spans, mark)
