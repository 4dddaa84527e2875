"""A sink whose parts are published together, once they cover what was expected."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .archives import local

_ONE, _TWO = "_hash_one", "_hash_two"


@dataclass
class _Part(WriterCommitMessage):
    """What a task says of the file that it wrote: name, rows, sums of two hashes of their keys."""

    file: str
    rows: int
    one: int
    two: int


class PartSink(DataSource):
    """Format ``covered_parts``; options ``path`` (new, on a shared mount), ``rows``, ``one`` and ``two`` of the expected keys.

    Each task writes a file of its own in a folder beside ``path``. The driver adds up what the committed tasks say, and
    renames the folder to ``path`` only if it agrees with what was expected; files of attempts that were not committed
    are removed first. So a failed, doubled or missing part leaves nothing at ``path``, and nothing is read again.
    """

    @classmethod
    def name(cls) -> str:
        return "covered_parts"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _PartWriter(self.options)


class _PartWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = local(options["path"].rstrip("/"))
        self.expected = tuple(int(options[k]) for k in ("rows", "one", "two"))
        self.stage = f"{self.path}.parts-{uuid.uuid4().hex}"
        os.makedirs(self.stage)  # by the driver alone, so a task that outlives an abort finds no folder to write to

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part | None:
        writer, name, rows, sums = None, f"part-{uuid.uuid4().hex}.parquet", 0, [0, 0]
        for batch in iterator:
            for i, c in enumerate((_ONE, _TWO)):
                sums[i] += sum(batch.column(batch.schema.get_field_index(c)).to_pylist())
            rows += batch.num_rows
            out = batch.drop_columns([_ONE, _TWO])
            if writer is None:
                writer = pyarrow.parquet.ParquetWriter(f"{self.stage}/{name}", out.schema)
            writer.write_batch(out)
        if writer is None:
            return _Part("", 0, 0, 0)
        writer.close()
        return _Part(name, rows, sums[0] % 2**64, sums[1] % 2**64)

    def commit(self, messages: list[_Part | None]) -> None:
        parts = [m for m in messages if m is not None]
        found = (sum(m.rows for m in parts), sum(m.one for m in parts) % 2**64, sum(m.two for m in parts) % 2**64)
        if found != self.expected:
            self.abort(messages)
            raise ValueError(f"parts do not cover what was expected: {found[0]} rows of {self.expected[0]}" + ", with other keys" * (found[0] == self.expected[0]))
        for name in set(os.listdir(self.stage)) - {m.file for m in parts}:
            os.remove(f"{self.stage}/{name}")
        with open(f"{self.stage}/_SUCCESS", "w"):
            pass
        os.rename(self.stage, self.path)

    def abort(self, messages: list[_Part | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


def write_covered(df: DataFrame, path: str, key: list[str], expected: DataFrame) -> None:
    """Writes ``df`` as Parquet parts at ``path`` if its keys are exactly the distinct keys of ``expected``, else nothing.

    Keys are compared by their number and by sums of two 64-bit hashes, gathered as the tasks write. A key that ``df`` has
    twice is an error, as is one that is missing or new. ``path`` must not exist.
    """
    if os.path.exists(local(path.rstrip("/"))):
        raise ValueError(f"{path} exists")
    spark = df.sparkSession
    spark.dataSource.register(PartSink)
    hashes = [F.xxhash64(F.lit(salt), *key) for salt in (1, 2)]
    keys = expected.select(*key).distinct().agg(F.count("*").alias("n"), *[F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias(f"h{i}") for i, h in enumerate(hashes)]).first()
    options = {"path": path, "rows": keys["n"], "one": int(keys["h0"]) % 2**64, "two": int(keys["h1"]) % 2**64}
    df.withColumns({_ONE: hashes[0], _TWO: hashes[1]}).write.format("covered_parts").mode("append").options(**options).save()
