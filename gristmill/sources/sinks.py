"""Sinks: partitioned splits, manifests, parts, immutable and resumable writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.hashing import hash8


def write_splits(df: DataFrame, path: str, split: str = "split", order: list[str] | None = None, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per split, files sorted within; a split's rows may be spread over many files."""
    sorted_ = df.repartition(F.col(split), F.pmod(F.xxhash64(*(order or [split])), F.lit(64))).sortWithinPartitions(split, *(order or []))
    sorted_.write.partitionBy(split).format(fmt).mode(mode).save(path)


def write_sorted_jsonl(df: DataFrame, path: str, split: str = "split", order: list[str] | None = None) -> None:
    """One folder per split with JSON lines whose top-level keys are sorted, in the order of ``order`` within and across files."""
    names = sorted(c for c in df.columns if c != split)
    line = F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"})
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in [split, *(order or [])]]
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(split, line.alias("value"))
    rows.write.partitionBy(split).mode("errorifexists").text(path)


def write_lock(catalog: DataFrame, path: str) -> str:
    """The lock file of a catalog of sources (``repo, revision`` and more): one sorted JSON line a source; its digest.

    A catalog is small: it has a row for each source.
    """
    lines = catalog.select("repo", F.to_json(F.struct(*sorted(catalog.columns))).alias("value")).orderBy("repo", "value")
    lines.select("value").coalesce(1).write.mode("errorifexists").text(path)
    return lock_digest(catalog.sparkSession, path)


def lock_digest(spark: SparkSession, path: str) -> str:
    lines = spark.read.text(path).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("value")), "\n"), 256).alias("d"))
    return lines.first()["d"]


def packaged(spark: SparkSession, path: str) -> DataFrame:
    """``file, path, bytes, sha256`` of every file below a folder, each read once by a task; ``file`` is the path in it."""
    files, root = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), path.rstrip("/").rsplit(":", 1)[-1] + "/"
    below = F.col("path").substr(F.instr("path", root) + len(root), F.length("path"))
    return files.select(below.alias("file"), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def readback(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files of a release that are missing, new or differ from what ``packaged`` said before; empty if all agree."""
    now = packaged(spark, path).select("file", F.col("sha256").alias("now"))
    both = expected.select("file", F.col("sha256").alias("was")).join(now, "file", "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))


def rewrite_keys(spark: SparkSession, path: str, by: str, changed: DataFrame, key: str, column: str) -> int:
    """Replaces ``column`` by that of ``changed`` (``key, column``) in the partitions of ``by`` that hold such rows; how many.

    Only those partitions are written again, each at once, from a copy that is stored first.
    """
    from gristmill.lineage import stored

    rows = spark.read.parquet(path)
    new = changed.select(key, F.col(column).alias("_new"), F.lit(True).alias("_there"))
    marked = rows.join(new, key, "left")
    touched = marked.where("_there").select(by).distinct()
    n = marked.where("_there").count()
    if n:
        done = marked.withColumn(column, F.when(F.col("_there"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_there")
        overwrite_partitions(stored(done.join(touched, by, "left_semi").select(*rows.columns)), path, by)
    return n


def split_digests(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Order-free digest of each split's rows that never gathers them: counts, sums and xors of row hashes."""
    h = F.xxhash64(*columns)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum"))


def hash_manifest(df: DataFrame, by: list[str], hexed) -> DataFrame:
    """``n, sum, xor, sum2, xor2`` of each split: of the first and second eight hex digits of its rows' digests.

    Equal for equal multisets of rows, in any order; partial sums are all that is shuffled, so a split may be the table.
    """
    words = [hash8(F.substring(hexed, at, 8)) for at in (1, 9)]
    named = [(w, end) for w, end in zip(words, ("", "2"))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[f(w).alias(f"{name}{end}") for w, end in named for f, name in ((F.sum, "sum"), (F.bit_xor, "xor"))])


def manifest(df: DataFrame, by: str, row: str, line) -> DataFrame:
    """SHA-256 of a split's lines by id, in one row for each ``by``; for small tables such as catalogs."""
    lines = F.sort_array(F.collect_list(F.struct(F.col(row).alias("r"), line.alias("l"))))
    return df.groupBy(by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(lines, lambda s: s["l"]), "\n"), 256).alias("sha256"))


def finalize_parts(spark: SparkSession, parts: list[str], expected: DataFrame, key: str, path: str) -> DataFrame:
    """Unites parts that were written apart; fails unless they are disjoint and cover ``expected``."""
    from gristmill.operators.leakage import coverage

    out = spark.read.parquet(*parts)
    bad = coverage(expected, out, key).first()
    if any(bad):
        raise ValueError(f"parts do not fit: {bad.asDict()}")
    out.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that ``df`` has; the committer makes each visible at once."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(by).mode("overwrite").parquet(path)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Writes a result, or checks that the one that is there has the same rows."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        old = spark.read.parquet(path)
        if not (old.exceptAll(df.select(*old.columns)).isEmpty() and df.select(*old.columns).exceptAll(old).isEmpty()):
            raise ValueError(f"{path} holds another result")
        return old
    df.write.parquet(path)
    return spark.read.parquet(path)


def append_missing(df: DataFrame, path: str, key: str, size: int = 64, lock: str | None = None) -> int:
    """Appends rows whose key is not there yet, ``size`` rows a file at most; the number of rows appended.

    Running it again after a failure goes on where it stopped. With ``lock``, a digest of what the rows were made from
    (see ``write_lock``), rows made from anything else are an error: it is kept beside ``path``.

    What is there is read once, for the keys. A file costs far more than its few rows, so the rows are dealt over four
    tasks a core at most, each with some files of its own: left to itself, Spark would go by bytes, and one task would
    write all files of a narrow table.
    """
    from gristmill.lineage import stable

    spark = df.sparkSession
    if lock is not None:
        held = write_once(spark.createDataFrame([(lock,)], "lock string"), path.rstrip("/") + ".lock")
        if held.first()["lock"] != lock:
            raise ValueError(f"{path} was made from other sources")
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    todo = df
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        missing = stable(df.select(key).join(spark.read.parquet(path).select(key), key, "left_anti").distinct()).withColumnRenamed(key, "_key")
        todo = df.join(missing, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    n = todo.count()
    if n:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        dealt = todo.repartition(min(tasks, -(-n // size)))
        dealt.write.option("maxRecordsPerFile", size).mode("append").parquet(path)
    return n


def write_quarantine(df: DataFrame, path: str, reason: str = "reason") -> None:
    """Accepted rows and rejected rows side by side under ``path``."""
    df.where(F.col(reason).isNull()).drop(reason).write.parquet(f"{path}/accepted")
    df.where(F.col(reason).isNotNull()).write.partitionBy(reason).parquet(f"{path}/rejected")


def metrics_markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report table as Markdown; reports are small, and ``limit`` guards the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a report")
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)])
