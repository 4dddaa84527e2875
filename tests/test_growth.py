"""Plans of queries that once grew faster than their limits: what is shuffled and what is computed for each row."""

from pyspark.sql import functions as F

from gristmill.functions import hashing
from gristmill.operators import splits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_digest_is_computed_once(spark):
    df = spark.range(40).select(F.when(F.col("id") < 0, "none").otherwise(splits.hashed("id", full=True)).alias("split"), "id")
    assert plan(df).count("sha2(") == 1
    for n in (3, 100, 1 << 30):
        rows = spark.range(40).select(hashing.digest("id").alias("h")).select("h", hashing.full_mod(F.col("h"), n).alias("m")).collect()
        assert all(r["m"] == int(r["h"], 16) % n for r in rows)
    ladder = splits.ladder(hashing.full_mod(hashing.digest("id"), 100), list(splits.LADDER), "test")
    assert df.select("split").collect() == spark.range(40).select(ladder.alias("split")).collect()


def test_near_codes_are_listed(spark):
    """A thousand codes that share their low bands: each lists 210 neighbours, none meets a thousand."""
    from gristmill.operators import neardup

    codes = spark.range(1000).select((F.col("id") * 1024).alias("c"))
    got = neardup.near_codes(codes, "c", 20, 2)
    values = [i * 1024 for i in range(1000)]
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    assert "Generate explode" in plan(got) and "bit_count" not in plan(got)


def test_rows_do_not_move_for_their_distractors(spark):
    """Before, each row met 64 candidates in a window, and came back by a join."""
    from gristmill.operators import distractors

    df = spark.range(300).select("id", (F.col("id") % 3).alias("g"), F.concat(F.lit("t"), F.col("id") % 90).alias("t"))
    got = distractors.with_others(df, "id", "g", "t", 3, "o", F.col("id") % 2 == 0)
    assert "Window" not in plan(got) and "SortMergeJoin" not in plan(got)
    sizes = got.groupBy(F.col("id") % 2 == 0).agg(F.collect_set(F.size("o"))).collect()
    assert {r[0]: r[1] for r in sizes} == {True: [3], False: [0]}


def test_draws_are_dealt_over_all_tasks(spark):
    """Before, the clusters' few bytes were united to one task for each core or fewer, however long their draws take."""
    from gristmill.operators import metrics

    wide = spark.range(400).select("id", F.lit(0).alias("a"), (F.col("id") % 2).alias("b"))
    got = metrics.cluster_bootstrap(wide, "id", 8)
    assert got.count() == 8
    assert "REPARTITION_BY_NUM" in plan(got).split("MapInArrow")[1]


def test_poisson_counts_at_the_cuts():
    import numpy as np

    from gristmill.operators import metrics

    near = [int(p * 2**32) + i for p in metrics.POISSON for i in (-1, 0, 1, 2)]
    words = np.array([0, 2**32 - 1, *near], dtype=np.uint32)
    assert metrics.poisson_counts(words).tolist() == [sum(w / 2**32 >= p for p in metrics.POISSON) for w in words.tolist()]


def test_many_small_files_are_written_by_many_tasks(spark, tmp_path):
    """Before, one partition wrote all its files one after the other; rows without a key are still appended."""
    from gristmill.sources import sinks

    path, df = str(tmp_path / "out"), spark.range(0, 600, 1, 1).select("id", F.lit("x").alias("v"))
    assert sinks.append_missing(df.where("id < 300"), path, "id", 10) == 300
    more = df.unionByName(spark.sql("SELECT cast(NULL AS bigint) AS id, 'n' AS v"))
    assert sinks.append_missing(more, path, "id", 10) == 301
    got = spark.read.parquet(path)
    assert got.count() == 601 and got.where("id IS NULL").count() == 1 and got.where("id IS NOT NULL").distinct().count() == 600
    files = [r["f"] for r in got.select(F.input_file_name().alias("f")).groupBy("f").count().where("count <= 10").collect()]
    assert len({f.rsplit("/", 1)[1].split("-c0")[0].split("-")[1] for f in files}) > 4 and len(files) >= 61


def test_archives_hold_no_copies_of_a_batch(spark, tmp_path):
    """Before, contents were copied to pandas objects a batch at a time; null and empty ones and many small ones are whole."""
    from gristmill.sources import archives

    texts = spark.range(0, 3000, 1, 2).select(F.concat(F.lit("m"), "id").alias("member"), F.when(F.col("id") % 7 > 0, F.repeat(F.col("id").cast("string"), (F.col("id") % 200).cast("int"))).cast("binary").alias("content"))
    for packed in (False, True):
        entries = archives.index(spark, archives.write(texts, f"{tmp_path}/{packed}", "member", "content", packed), f"{tmp_path}/i{packed}")
        got = archives.members(entries)
        assert "MapInArrow" in plan(got) and "MapInPandas" not in plan(got)
        want = texts.select("member", F.coalesce("content", F.lit(b"")).alias("content"))
        assert got.select("member", "content").exceptAll(want).isEmpty() and got.count() == 3000
