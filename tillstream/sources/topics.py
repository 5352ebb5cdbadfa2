"""Message logs behind one interface: a Kafka topic, or a folder of Parquet files.

Both give the columns of `TOPIC_SCHEMA`. The Kafka form needs the connector package on the
class path; the folder form needs nothing and is what the tests run on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.functions.fields import column
from tillstream.schema import ORDER_TOPIC, RESULT_TOPIC, TOPIC_SCHEMA

# Arrival order of messages. Offsets only order messages of one partition, and a folder
# counts them anew for every publish, so the publish time comes first. Within one publish to a
# folder, partition and offset are the task and the row in it: an order, but a made-up one.
ARRIVAL = ("timestamp", "partition", "offset")


def order_payload(lines: DataFrame, blank: str | None = None) -> Column:
    """One JSON object per row, every value as text. NULL fields are kept, or written as the
    `blank` text: rows of a CSV file have blank cells, which are empty texts."""
    cells = [column(name).cast("string") for name in lines.columns]
    if blank is not None:
        cells = [F.coalesce(cell, F.lit(blank)) for cell in cells]
    cells = [cell.alias(name) for cell, name in zip(cells, lines.columns)]
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


@dataclass(frozen=True)
class FolderTopic:
    """Messages as Parquet files. `split_by` names columns that become folder levels, so a
    reader that filters on them opens only the matching folders. A topic that is only read may have
    a pattern as path. `per_file` caps the messages of
    a file; readers of a topic that was published so can be throttled by messages."""

    path: str
    name: str
    split_by: tuple[tuple[str, T.DataType], ...] = ()
    per_file: int | None = None

    def _schema(self) -> T.StructType:
        levels = [T.StructField(name, kind) for name, kind in self.split_by]
        return T.StructType(TOPIC_SCHEMA.fields + levels)

    def _messages(self, rows: DataFrame) -> DataFrame:
        # The id holds the task number in its upper bits and counts up within the task.
        position = F.monotonically_increasing_id()
        return rows.select(
            F.lit(None).cast("binary").alias("key"),
            F.col("value").cast("binary").alias("value"),
            F.lit(self.name).alias("topic"),
            F.shiftright(position, 33).cast("int").alias("partition"),
            position.bitwiseAND(F.lit((1 << 33) - 1)).alias("offset"),
            F.current_timestamp().alias("timestamp"),
            *[F.col(name) for name, _ in self.split_by],
        )

    def append(self, rows: DataFrame) -> None:
        """Add one message per row of `rows` (a `value` column, plus the split columns)."""
        writer = self._sized(self._messages(rows).write.mode("append"))
        if self.split_by:
            writer = writer.partitionBy(*[name for name, _ in self.split_by])
        writer.parquet(self.path)

    def replace(self, rows: DataFrame) -> None:
        """Like append, but folders that `rows` falls into are written anew, so a batch
        that runs twice leaves its messages once."""
        (
            self._sized(self._messages(rows).write.mode("overwrite"))
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*[name for name, _ in self.split_by])
            .parquet(self.path)
        )

    def _sized(self, writer: DataFrameWriter) -> DataFrameWriter:
        # Messages repeat their field names and most values, which this codec halves again.
        writer = writer.option("compression", "zstd")
        return writer.option("maxRecordsPerFile", self.per_file) if self.per_file else writer

    def replay(self, spark: SparkSession) -> DataFrame:
        """All messages there are now, as a table."""
        return spark.read.schema(self._schema()).parquet(self.path)

    def stream(self, spark: SparkSession, limit: int | None = None) -> DataFrame:
        """Messages as they arrive; `limit` caps the messages taken per batch if the topic has
        a number of messages per file, else the files."""
        reader = spark.readStream.schema(self._schema())
        if limit:
            if self.per_file and limit < self.per_file:
                raise ValueError(f"files hold up to {self.per_file} messages: no batch of {limit}")
            reader = reader.option("maxFilesPerTrigger", limit // (self.per_file or 1))
        return reader.parquet(self.path)


@dataclass(frozen=True)
class KafkaTopic:
    """Messages in a Kafka topic. Not covered by the tests: they have no broker."""

    servers: str
    name: str
    starting: str = "latest"
    options: dict[str, str] = field(default_factory=dict)

    def append(self, rows: DataFrame) -> None:
        (
            rows.select(F.col("value").cast("string").alias("value"))
            .write.format("kafka")
            .option("kafka.bootstrap.servers", self.servers)
            .option("topic", self.name)
            .options(**self.options)
            .save()
        )

    # A broker cannot take messages back: a repeated batch repeats its messages. Readers keep
    # one message per metric, run, epoch and key (`readside.without_repeats`).
    replace = append

    def replay(self, spark: SparkSession) -> DataFrame:
        return (
            spark.read.format("kafka")
            .option("kafka.bootstrap.servers", self.servers)
            .option("subscribe", self.name)
            .option("startingOffsets", "earliest")
            .option("endingOffsets", "latest")
            .options(**self.options)
            .load()
        )

    def stream(self, spark: SparkSession, limit: int | None = None) -> DataFrame:
        reader = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", self.servers)
            .option("subscribe", self.name)
            .option("startingOffsets", self.starting)
            .options(**self.options)
        )
        if limit:
            reader = reader.option("maxOffsetsPerTrigger", limit)
        return reader.load()


Topic = FolderTopic | KafkaTopic


def result_folder(path: str) -> FolderTopic:
    """The result log as a folder: one sub-folder per metric, run and epoch."""
    return FolderTopic(
        path, RESULT_TOPIC,
        (("metric", T.StringType()), ("run_id", T.StringType()), ("epoch_id", T.LongType())),
    )


def order_folder(path: str, per_file: int | None = None) -> FolderTopic:
    return FolderTopic(path, ORDER_TOPIC, per_file=per_file)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


# The newest snapshots ------------------------------------------------------------------

_POINTERS = "_snapshots"  # a hidden folder of the log: readers of messages pass it over
_POINTER_SCHEMA = "metric string, epoch_id long, published_at timestamp"


def note_snapshot(
    topic: Topic, spark: SparkSession, names: list[str], run_id: str, epoch_id: int
) -> None:
    """Records that a run has published an epoch of some metrics, once the snapshot is there.

    A run has two small files that take turns, each with the last snapshot of all its metrics,
    so one is whole whenever the other is being written. Runs do not touch each other's.
    """
    if not isinstance(topic, FolderTopic):
        return
    path = f"{topic.path}/{_POINTERS}/run_id={run_id}"
    noted = snapshots(topic, spark, run_id)
    others = [] if noted is None else noted.where(~F.col("metric").isin(names)).collect()
    last = {}
    for row in others:
        if row.metric not in last or row.published_at > last[row.metric].published_at:
            last[row.metric] = row
    rows = [(name, epoch_id, None) for name in names]
    rows += [(row.metric, row.epoch_id, row.published_at) for row in last.values()]
    (
        spark.createDataFrame(rows, _POINTER_SCHEMA)
        .withColumn("published_at", F.coalesce("published_at", F.current_timestamp()))
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/turn={epoch_id % 2}")
    )


def snapshots(topic: Topic, spark: SparkSession, run_id: str | None = None) -> DataFrame | None:
    """The last snapshots of all runs or of one: metric, epoch_id, published_at, run_id. None if
    none is recorded."""
    if not isinstance(topic, FolderTopic):
        return None
    root = f"{topic.path}/{_POINTERS}"
    path = root if run_id is None else f"{root}/run_id={run_id}"
    if not exists(spark, path):
        return None
    reader = spark.read.option("basePath", root).option("ignoreMissingFiles", "true")
    return reader.schema(f"{_POINTER_SCHEMA}, run_id string, turn int").parquet(path).drop("turn")


def newest_snapshots(topic: Topic, spark: SparkSession) -> dict[str, tuple[str, int]] | None:
    """Run and epoch of every metric's newest snapshot, as values a scan can be pruned by.
    The driver gets one row per metric. None if the log records none."""
    noted = snapshots(topic, spark)
    if noted is None:
        return None
    newest = noted.groupBy("metric").agg(F.max(F.struct(
        "published_at", "epoch_id", "run_id")).alias("last"))
    return {row.metric: (row["last"].run_id, row["last"].epoch_id) for row in newest.collect()}
