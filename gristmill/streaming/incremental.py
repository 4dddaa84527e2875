"""Resumable file streams: what has been processed is in the stream's checkpoint, not in the program."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gristmill.lineage import shared_dir


def read_new(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive under a path or glob."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def append_available(stream: DataFrame, out: str, checkpoint: str, key: str | None = None) -> int:
    """Appends what is there now and stops; the next call goes on from there. Returns rows of this call.

    With ``key`` a row whose key came before, in this or an earlier call, is dropped by keyed state.
    """
    unique = stream.dropDuplicates([key]) if key else stream
    query = unique.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return sum(p.numInputRows for p in query.recentProgress)


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by tumbling window; rows later than the watermark are dropped by the stream."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def run_available(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its output from the shared folder as a batch."""
    base = f"{shared_dir(spark).rstrip('/')}/gristmill-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


class Progress(StreamingQueryListener):
    """Keeps the row counts of each progress report."""

    def __init__(self):
        self.rows: list[int] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows.append(event.progress.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def wait_for(ready: Callable[[], bool], timeout: float, every: float = 1.0) -> float:
    """Polls until ``ready`` holds; the seconds it took. ``TimeoutError`` where it does not within ``timeout`` seconds."""
    began = time.monotonic()
    while not ready():
        if time.monotonic() - began > timeout:
            raise TimeoutError(f"not ready after {timeout} s")
        time.sleep(every)
    return time.monotonic() - began


def written(spark: SparkSession, path: str) -> bool:
    """Whether a Spark job has completed its output there."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
