"""The keyed table as a sink of its own: `writeStream.format("keyed_orders")`.

Tasks write files of rows; only when all tasks of a batch have succeeded does the driver commit
them by naming them in a small file per run and batch. Readers take committed files only, so a
batch that failed leaves nothing, and one that runs again after its commit adds nothing. The
folder may be on any file system that pyarrow knows; it must be one all executors reach.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceStreamArrowWriter, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tillstream.session import ship_package

NAME = "keyed_orders"
FILES, COMMITS = "files", "commits"


@dataclass
class Written(WriterCommitMessage):
    """The file one task wrote, or None if it had no rows."""

    file: str | None
    rows: int = 0


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class KeyedOrdersWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _place(self.path)
        name, writer, rows = f"{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                if writer is None:
                    system.create_dir(f"{root}/{FILES}", recursive=True)
                    writer = pq.ParquetWriter(f"{root}/{FILES}/{name}", batch.schema,
                                              compression="zstd", filesystem=system)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(name if writer is not None else None, rows)

    def _remove(self, messages) -> None:
        system, root = _place(self.path)
        for message in messages:
            if message is not None and message.file:
                system.delete_file(f"{root}/{FILES}/{message.file}")

    def commit(self, messages, batchId: int) -> None:
        system, root = _place(self.path)
        system.create_dir(f"{root}/{COMMITS}", recursive=True)
        target = f"{root}/{COMMITS}/{self.run}-{batchId}.json"
        if system.get_file_info(target).type != fs.FileType.NotFound:
            self._remove(messages)  # the batch was committed before the restart
            return
        files = [message.file for message in messages if message and message.file]
        # Written aside and moved, so readers meet all of it or none.
        aside = f"{root}/{COMMITS}/.{self.run}-{batchId}.{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as out:
            out.write(json.dumps({
                "run": self.run, "batch": batchId, "files": files,
                "rows": sum(m.rows for m in messages if m)}).encode())
        system.move(aside, target)

    def abort(self, messages, batchId: int) -> None:
        self._remove(messages)


class KeyedOrders(DataSource):
    """Options: `path`, and `run`, the name of what one checkpoint belongs to."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema: StructType, overwrite: bool) -> KeyedOrdersWriter:
        return KeyedOrdersWriter(self.options["path"], self.options["run"])


def run_name(checkpoint: str) -> str:
    """Batch numbers start anew with every checkpoint, so its place tells runs apart."""
    return hashlib.md5(checkpoint.encode()).hexdigest()[:12]


_known: set[str] = set()


def register(spark: SparkSession) -> None:
    """Makes the sink known to a session; once is enough."""
    ship_package(spark)
    session = spark._jsparkSession.sessionUUID()
    if session not in _known:
        spark.dataSource.register(KeyedOrders)
        _known.add(session)


def committed_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of committed batches; `sinks.latest_orders` makes them the keyed table."""
    named = spark.read.schema("files array<string>").json(f"{path}/{COMMITS}").select(
        F.explode("files").alias("__file"))
    rows = spark.read.parquet(f"{path}/{FILES}").withColumn("__file", F.col("_metadata.file_name"))
    return rows.join(named, "__file", "left_semi").drop("__file")
