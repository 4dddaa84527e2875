"""Wrong options for questions, ranked by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.hashing import digest, hash8
from gristmill.lineage import stable
from gristmill.operators.skew import broadcast_small, spread_join

#: Texts of one bucket on average, and of the pool that rows fall back on, for each group.
BUCKET = 64


def _fallback(texts: DataFrame, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Groups that need a pool of their own, and ``_own, _pt``: for each of them, and for null all others, the first ``size`` texts by hash that are not its alone.

    A text is of one group alone, or of several. The first ``size`` texts of all serve every group that has none of them
    alone; there are at most ``size`` groups that have, and for these it takes the first ``size`` texts of none of them
    and of each. So the pool has at most ``size * (size + 2)`` texts, whatever the table, and is found by top-k.
    """
    by_hash = [digest(F.lit("pool"), text), F.col(text)]
    alone = F.when(F.col("_low").eqNullSafe(F.col("_high")), F.struct(F.col("_low").alias("g")))
    rows = texts.select(text, alone.alias("_alone"))
    first = stable(rows.orderBy(*by_hash).limit(size))
    owners = first.where("_alone IS NOT NULL").select("_alone").distinct()
    of_owner = rows.join(F.broadcast(owners), "_alone", "left_semi")  # at most ``size`` groups
    each = of_owner.withColumn("_i", F.row_number().over(Window.partitionBy("_alone").orderBy(*by_hash))).where(F.col("_i") <= size).drop("_i")
    of_none = rows.join(F.broadcast(owners), "_alone", "left_anti").orderBy(*by_hash).limit(size)
    pool = first.unionByName(each.select(*rows.columns)).unionByName(of_none.select(*rows.columns)).distinct()
    groups = owners.select(F.col("_alone").alias("_own")).unionByName(owners.sparkSession.createDataFrame([(None,)], f"_own {dict(owners.dtypes)['_alone']}"))
    met = pool.join(F.broadcast(groups), ~F.coalesce(F.col("_alone") == F.col("_own"), F.lit(False)), "inner")
    rank = F.row_number().over(Window.partitionBy("_own").orderBy(*by_hash))
    return stable(owners), stable(met.withColumn("_i", rank).where(F.col("_i") <= size).select("_own", F.col(text).alias("_pt")))


def with_others(df: DataFrame, row: str, group: str, text: str, k: int, out: str, where: Column | None = None) -> DataFrame:
    """``df`` with an array ``out`` of k different texts of other groups beside each row, without pairs of all and without rounds.

    Texts are dealt into buckets by hash; a row's candidates are those of the bucket of its own hash, ranked by a digest
    of row and text. A row that finds fewer than k there, as its group has most of the bucket, goes on with a pool of
    64 texts that is the same for all rows of its group: the first by hash that other groups have, ranked likewise. So one
    join with buckets of bounded size and one with a small pool do, however the texts are dealt over groups, and a row gets
    fewer than k only if there are no more. A text that other groups have too is one of theirs; a row's own text is
    none. ``row`` must be a key; a null group is a group. Rows outside ``where`` get an empty array and give no text.

    A bucket is one array that is ranked inside the row, so rows meet no candidates by a shuffle: only texts are
    shuffled, and rows where the buckets are too large to be broadcast.
    """
    where = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    one = F.struct(F.col(group).alias("g"))  # so null is a group
    texts = df.where(where & F.col(text).isNotNull()).groupBy(text).agg(F.min(one).alias("_low"), F.max(one).alias("_high"))
    texts = stable(texts.select(text, F.col("_low.g").alias("_low"), F.col("_high.g").alias("_high")))
    n, size = max(1, -(-texts.count() // BUCKET)), max(BUCKET, 3 * k)
    spread = lambda c: (hash8(digest(F.lit("pool"), c)) % n).cast("int")
    candidate = F.struct(F.col(text).alias("t"), F.col("_low").alias("low"), F.col("_high").alias("high"))
    buckets = stable(texts.groupBy(spread(text).alias("_b")).agg(F.collect_list(candidate).alias("_bucket")))  # ``BUCKET`` on average
    owners, pool = _fallback(texts, text, size)
    pools = pool.groupBy("_own").agg(F.collect_list(F.struct(F.col("_pt").alias("t"), spread("_pt").alias("b"))).alias("_pool"))

    def ranked(texts_: Column, most: Column) -> Column:
        """By ``digest(row, text)``: 64 hex digits before each text are sorted as one string."""
        keyed = F.transform(texts_, lambda s: F.concat(F.sha2(F.concat("_start", s["t"].cast("string")), 256), s["t"].cast("string")))
        return F.transform(F.slice(F.sort_array(keyed), F.lit(1), most), lambda x: F.substring(x, 65, 1 << 30).cast(kind))

    kind, start = dict(df.dtypes)[text], F.concat_ws(":", F.col(row).cast("string"), F.lit(""))
    own = lambda s: F.col(text).eqNullSafe(s["t"])
    home = lambda s: F.col(group).eqNullSafe(s["low"]) & F.col(group).eqNullSafe(s["high"])
    met = df.withColumns({"_for": where, "_at": spread(row), "_start": start}).join(broadcast_small(buckets), (F.col("_at") == F.col("_b")) & F.col("_for"), "left")
    near = ranked(F.filter("_bucket", lambda s: ~(own(s) | home(s))), F.lit(k))
    met = met.withColumn("_near", F.coalesce(near, F.array().cast(f"array<{kind}>"))).drop("_b", "_bucket")
    few = F.col("_for") & (F.size("_near") < k)
    # The pool's rows and its groups are bounded by its size, so they are broadcast.
    keyed = met.join(F.broadcast(owners.select(F.col("_alone").alias("_owner"))), (one == F.col("_owner")) & few, "left")
    full = keyed.join(F.broadcast(pools), F.col("_owner").eqNullSafe(F.col("_own")) & few, "left")
    more = ranked(F.filter("_pool", lambda s: ~own(s) & (s["b"] != F.col("_at"))), F.lit(k) - F.size("_near"))
    return full.withColumn(out, F.when(F.col("_pool").isNull(), F.col("_near")).otherwise(F.concat("_near", more))).drop("_for", "_at", "_start", "_near", "_owner", "_own", "_pool")


def from_other_groups(df: DataFrame, row: str, group: str, text: str, k: int) -> DataFrame:
    """``row, rank, text``: the texts of ``with_others``, one a row."""
    each = with_others(df.select(*dict.fromkeys([row, group, text])), row, group, text, k, "_others")
    return each.select(row, F.posexplode("_others").alias("_i", "_o")).select(row, (F.col("_i") + 1).alias("rank"), F.col("_o").alias(text))


def from_vocabulary(df: DataFrame, label: str, k: int) -> DataFrame:
    """``label, other, shared, rank``: for each label the k others with most words in common.

    Others that share two words or more come first, most words first, ties by a digest of both. Two such labels share a word
    that is not the most frequent one of either, so labels meet by these only, and a word that all labels have brings
    none together. A label with fewer than k goes on with labels that share one word, drawn from the 64 first by hash
    of each of its words, then with any, drawn by hash. The words of a label are what stands between single blanks.
    """
    v = stable(df.select(label).where(F.col(label).isNotNull()).distinct())
    words = stable(v.select(label, F.explode(F.array_distinct(F.split(label, " "))).alias("_w")))
    sizes = stable(words.groupBy("_w").agg(F.count("*").alias("_c")))
    total = sizes.agg(F.sum("_c")).first()[0] or 0
    counted = spread_join(words, sizes.withColumn("_size", F.col("_c")), "_w", "_c", total)
    sets = counted.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("_size", "_w"))).alias("_all"))  # rare words first
    sets = stable(sets.select(label, F.col("_all._w").alias("_all")))
    keyed = sets.select(label, "_all", F.explode(F.slice("_all", 1, F.size("_all") - 1)).alias("_w"))
    met = keyed.join(keyed.select(F.col(label).alias("other"), F.col("_all").alias("_theirs"), F.col("_w").alias("_v")), F.col("_w") == F.col("_v"))
    pairs = met.where(F.col(label) != F.col("other")).select(label, "other", F.size(F.array_intersect("_all", "_theirs")).alias("shared")).where("shared > 1").distinct()
    rank = lambda *first: F.row_number().over(Window.partitionBy(label).orderBy(*first, digest(label, "other")))
    out = stable(pairs.withColumn("rank", rank(F.desc("shared"))).where(F.col("rank") <= k))

    def short(found: DataFrame) -> DataFrame:
        return v.join(found.groupBy(label).agg(F.count("*").alias("_n")), label, "left").withColumn("_n", F.coalesce("_n", F.lit(0))).where(F.col("_n") < k)

    def filled(found: DataFrame, some: DataFrame, shared: int) -> DataFrame:
        more = some.withColumn("_i", rank() + F.col("_n")).where(F.col("_i") <= k)
        return found.unionByName(more.select(label, "other", F.lit(shared).alias("shared"), F.col("_i").cast("int").alias("rank")))

    few = stable(short(out))
    if few.isEmpty():
        return out
    place = F.row_number().over(Window.partitionBy("_w").orderBy(digest(F.lit("pool"), label), label))
    pool = words.withColumn("_i", place).where(F.col("_i") <= BUCKET).groupBy("_w").agg(F.collect_list(label).alias("_pool"))
    asking = stable(words.join(few, label))
    side = stable(pool.join(asking.groupBy("_w").agg(F.count("*").alias("_c")), "_w"))
    one = spread_join(asking, side, "_w", "_c", asking.count()).select(label, "_n", "_w", F.explode("_pool").alias("other")).where(F.col(label) != F.col("other"))
    mine, theirs = F.split(label, " "), F.split("other", " ")
    out = stable(filled(out, one.where(F.size(F.array_intersect(mine, theirs)) == 1).select(label, "_n", "other").distinct(), 1))
    few = stable(short(out))
    if few.isEmpty():
        return out
    any_ = from_other_groups(v.withColumn("_g", F.col(label)).withColumn("_t", F.col(label)), label, "_g", "_t", 2 * k)
    rest = any_.withColumnRenamed("_t", "other").join(few, label).where(~F.arrays_overlap(F.split(label, " "), F.split("other", " ")))
    return filled(out, rest.select(label, "_n", "other"), 0)
