"""What a streaming job does with each micro-batch.

Every sink writes a batch under the id of its query and its batch number. The id belongs to the
checkpoint: a restarted job goes on under it, and a job with a new checkpoint gets a new one and
never meets the folders of another. A batch that runs again replaces its own rows, so it leaves
them once. An error fails the batch; nothing is skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tillstream.operators import keyed, metrics, readside, recent
from tillstream.schema import FAMILIES, TOP_N, TREND_MINUTES
from tillstream.sources.topics import Topic, exists, note_snapshot, snapshots

BatchWriter = Callable[[DataFrame, int], None]

COMPACTED = "compacted"
CODEC = "zstd"  # stored rows are written once and take a large part of a job's disk traffic


def run_id(batch: DataFrame) -> str:
    """The id of the query a batch belongs to, which its checkpoint keeps over restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def publish_metrics(
    topic: Topic, rows_by_metric: dict[str, DataFrame], epoch_id: int, run: str = "batch"
) -> None:
    """Metric tables to the result topic as one snapshot, in one write. A snapshot that is
    noted as published is not written again: its files may have been read already."""
    spark = next(iter(rows_by_metric.values())).sparkSession
    noted = snapshots(topic, spark, run)
    if noted is not None and not noted.where(
            (F.col("epoch_id") >= epoch_id) & F.col("metric").isin(list(rows_by_metric))).isEmpty():
        return
    messages = metrics.result_messages(rows_by_metric, epoch_id, run)
    # Small tables become one file each, large ones files of the advised size.
    topic.replace(messages.hint("rebalance", "metric"))
    note_snapshot(topic, spark, list(rows_by_metric), run, epoch_id)


def _snapshot_sink(topic: Topic, split: Callable[[DataFrame], dict[str, DataFrame]]) -> BatchWriter:
    def write(snapshot: DataFrame, epoch_id: int) -> None:
        run = run_id(snapshot)
        # Kept while it is looked at, written and split, so the state is read only once.
        kept = snapshot.persist()
        try:
            if not kept.isEmpty():
                publish_metrics(topic, split(kept), epoch_id, run)
        finally:
            kept.unpersist()

    return write


def metric_sink(topic: Topic, metric: metrics.Metric) -> BatchWriter:
    """Snapshots of one metric from its totals; an empty one is not published."""
    return _snapshot_sink(topic, lambda totals: {metric.name: metric.finish(totals)})


def one_pass_sink(topic: Topic, wanted: tuple[metrics.Metric, ...] = metrics.ALL) -> BatchWriter:
    """Snapshots of `compute_all`, published as the metrics they contain."""
    return _snapshot_sink(
        topic, lambda totals: {m.name: metrics.pick(totals, m) for m in wanted}
    )


# What the sinks add to rows.
OWN_COLUMNS = ("run_id", "batch_id", "stored_at")


def beside_own(rows: DataFrame) -> DataFrame:
    """Fields named like a column of the sinks, as those of result messages are, get the prefix
    `message_`: both are kept."""
    return rows.withColumnsRenamed({name: f"message_{name}" for name in OWN_COLUMNS})


def rows_sink(path: str, split_by: str | None = None, gather: bool = True) -> BatchWriter:
    """The rows of each batch in a folder of their own, `run_id=.../batch_id=...`, with the
    time they were stored at; below that, if asked, a folder per value of a column, whose rows are
    gathered in few files. Without `gather` they stay in the tasks that have them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("stored_at", F.current_timestamp())
        if split_by and gather:
            rows = rows.hint("rebalance", split_by)
        writer = rows.write.mode("overwrite").option("compression", CODEC)
        if split_by:
            writer = writer.partitionBy(split_by)
        writer.parquet(f"{path}/run_id={run_id(batch)}/batch_id={batch_id}")

    return write


# Changed totals ------------------------------------------------------------------------

# A run with a new checkpoint starts from nothing. Its totals count only once it has caught up,
# which is recorded here, a hidden folder with one small file per run that did.
_GENERATIONS = "_generations"
_GENERATION_SCHEMA = "run string, since timestamp"


def hand_over(spark: SparkSession, path: str, run: str) -> None:
    """From now on the totals of this run are the current ones. A run takes over once: neither
    a restart of it nor an older run that is still alive takes over again."""
    place = f"{path}/{_GENERATIONS}/{run}"
    if exists(spark, path) and not exists(spark, f"{place}/_SUCCESS"):
        spark.createDataFrame([(run, None)], _GENERATION_SCHEMA).select(
            "run", F.current_timestamp().alias("since")).coalesce(1).write.mode(
            "overwrite").parquet(place)


def current_run(spark: SparkSession, path: str) -> str | None:
    """The run that took over last; before any did, the one that stored first. None if nothing
    is stored. The driver gets one row."""
    if exists(spark, f"{path}/{_GENERATIONS}"):
        taken = spark.read.schema(_GENERATION_SCHEMA).option("recursiveFileLookup", "true").parquet(
            f"{path}/{_GENERATIONS}")
        last = taken.agg(F.max_by("run", F.struct("since", "run")).alias("run")).first().run
        if last is not None:
            return last
    if not exists(spark, path):
        return None
    return spark.read.parquet(path).agg(F.min_by(
        "run_id", F.struct("stored_at", "run_id")).alias("run")).first().run


def current_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals that changed batches (`rows_sink` of `compute_all` in update mode) add up to:
    of every key the row of its last batch, in the current run."""
    changes = spark.read.parquet(path)
    run = F.lit(current_run(spark, path))
    rows = changes.where(F.col("run_id") == run).drop("run_id", "stored_at")
    return keyed.latest_per_key(rows, ["key_set", "window_start", "key"], ["batch_id"])


def compact_totals(spark: SparkSession, path: str, new_path: str) -> None:
    """The current totals in a new folder, without the rows that later batches replaced.

    Run it between two runs of the job and give the job the new folder. The totals lie there as
    the last batch of the same run, so a job that goes on with its checkpoint adds its batches
    behind them."""
    run = current_run(spark, path)
    last = spark.read.parquet(path).where(F.col("run_id") == F.lit(run)).agg(
        F.max("batch_id").alias("last")).first().last
    (
        current_totals(spark, path).drop("batch_id")
        .withColumn("stored_at", F.current_timestamp())
        .hint("rebalance", "key_set")
        .write.mode("overwrite").partitionBy("key_set")
        .parquet(f"{new_path}/run_id={run}/batch_id={last}")
    )
    hand_over(spark, new_path, run)


# Top lists -----------------------------------------------------------------------------

def best_sink(path: str, metric: metrics.Metric, buckets: int | None = None) -> BatchWriter:
    """A top list kept up from the totals that each batch changed.

    Totals lie in buckets of keys. A batch stores the totals it changed and ranks again only the
    buckets these fall into; the list of a bucket is no longer than the top list. The other
    buckets' lists stay as they are, and reading puts all lists together."""
    buckets = buckets or BUCKETS
    store = rows_sink(f"{path}/totals", "bucket")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, run_id(batch)
        store(batch.withColumn("bucket", bucket_of(F.coalesce(
            F.col(metric.key).cast("string"), F.lit("")), buckets)), batch_id)
        stored = spark.read.option("basePath", f"{path}/totals").parquet(
            f"{path}/totals/run_id={run}").where(F.col("batch_id") <= batch_id)
        changed = [row.bucket for row in stored.where(F.col("batch_id") == batch_id).select(
            "bucket").distinct().collect()]  # at most as many as there are buckets
        totals = keyed.latest_per_key(
            stored.where(F.col("bucket").isin(changed)).drop("run_id", "stored_at"),
            ["bucket", metric.key], ["batch_id"]).drop("batch_id")
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy(
            F.desc(metric.top_by), F.asc(metric.key)))
        best = totals.withColumn("__rank", rank).where(F.col("__rank") <= TOP_N).drop("__rank")
        best.write.mode("overwrite").partitionBy("bucket").parquet(
            f"{path}/best/run_id={run}/batch_id={batch_id}")

    return write


def current_best(spark: SparkSession, path: str, metric: metrics.Metric) -> DataFrame:
    """The top list as it stands, from the newest list of every bucket, in the current run."""
    lists = spark.read.parquet(f"{path}/best").where(
        F.col("run_id") == F.lit(current_run(spark, f"{path}/totals")))
    newest = lists.groupBy("bucket").agg(F.max("batch_id").alias("batch_id"))
    return metric.finish(lists.join(newest, ["bucket", "batch_id"], "left_semi"))


# A trend that closes -------------------------------------------------------------------

_CLOSED = "_closed"
_CLOSED_SCHEMA = "batch long, closed timestamp"


def trend_sink(path: str, metric: metrics.Metric, lateness: str) -> BatchWriter:
    """Windows close `lateness` after the latest event time of the batches before. Lines of open
    windows are added up per batch, with no state in between; lines of closed ones are late and
    kept as they are. A batch that runs again meets the same windows closed."""
    trend, late = rows_sink(f"{path}/trend"), rows_sink(f"{path}/late")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, place = batch.sparkSession, f"{path}/{_CLOSED}/{run_id(batch)}"
        closed = None
        if exists(spark, place):
            closed = spark.read.schema(_CLOSED_SCHEMA).parquet(place).where(
                F.col("batch") < batch_id).agg(F.max("closed").alias("x")).first().x
        lines = batch.persist()
        try:
            end = F.window("timestamp", f"{TREND_MINUTES} minutes")["end"]
            is_late = F.coalesce(end <= F.lit(closed).cast("timestamp"), F.lit(False))
            trend(metric.totals(lines.where(~is_late)), batch_id)
            late(lines.where(is_late), batch_id)
            spark.range(1).select(F.lit(batch_id).cast("long").alias("batch")).join(
                lines.agg(F.greatest(F.max("timestamp") - F.expr(f"INTERVAL {lateness}"), F.lit(
                    closed).cast("timestamp")).alias("closed"))).coalesce(1).write.mode(
                "overwrite").parquet(f"{place}/batch={batch_id}")
        finally:
            lines.unpersist()

    return write


def restate_trend(spark: SparkSession, path: str, metric: metrics.Metric) -> None:
    """Adds the late lines that have come since the last correction to their closed windows."""
    if not exists(spark, f"{path}/late"):
        return
    late, done = spark.read.parquet(f"{path}/late"), f"{path}/corrections"
    if exists(spark, done):
        corrected = spark.read.parquet(done).select("run_id", F.col("upto").cast("long").alias(
            "upto")).groupBy("run_id").agg(F.max("upto").alias("upto"))
        late = late.join(corrected, "run_id", "left").where(
            F.col("upto").isNull() | (F.col("batch_id") > F.col("upto"))).drop("upto")
    # One value per run of the job.
    for run, upto in late.groupBy("run_id").agg(F.max("batch_id")).collect():
        mine = late.where((F.col("run_id") == run) & (F.col("batch_id") <= upto))
        metric.totals(mine).write.mode("overwrite").parquet(f"{done}/run_id={run}/upto={upto}")


def stored_trend(
    spark: SparkSession, path: str, metric: metrics.Metric, corrected: bool = True
) -> DataFrame:
    """The windows as they stand, with corrections or without."""
    columns = ["window", metric.key, *[m.name for m in metric.measures]]
    parts = spark.read.parquet(f"{path}/trend").select(*columns)
    if corrected and exists(spark, f"{path}/corrections"):
        parts = parts.union(spark.read.parquet(f"{path}/corrections").select(*columns))
    return parts.groupBy("window", metric.key).agg(
        *[F.sum(m.name).alias(m.name) for m in metric.measures])


# The keyed table -----------------------------------------------------------------------

BUCKETS = 16


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert_sink(
    path: str, key: str = "order_id", order_by: list[str] | None = None, buckets: int = BUCKETS
) -> BatchWriter:
    """Keyed table as a log of batches, each holding its latest row per key, split into
    buckets of keys: who looks for a key opens one bucket.

    Expects wire text fields plus `position`, the place of the message in the topic. Rows move
    once, to find the latest per key; the tasks that hold these write them into all buckets.
    """
    store = rows_sink(path, "bucket", gather=False)

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.where(keyed.has_key(key)).withColumn("row_key", F.col(key).cast("string"))
        latest = keyed.latest_per_key(marked, ["row_key"], order_by or ["position"])
        rows = keyed.to_families(latest, key, "position")
        store(rows.withColumn("bucket", bucket_of(F.col("row_key"), buckets)), batch_id)

    return write


def latest_orders(
    table: DataFrame, order_by: list[str] | None = None, keys: Sequence[str] = ("row_key",)
) -> DataFrame:
    """The keyed table as it stands, from its log of batches: for every key the row that came
    last in the topic, whatever run stored it, or the row with the highest `order_by` fields.
    `keys` may name columns that follow from the key, by which the rows lie already."""
    rows = table.drop("run_id", "batch_id", "stored_at")
    if order_by is None:
        return keyed.latest_per_key(rows, [*keys], ["position"])
    # Flat, so that no field is sent twice, as what rows are ordered by and in its family.
    rest = [name for name in rows.columns if name not in ("row_key", *FAMILIES)]
    flat = rows.select("row_key", *keyed.family_fields(), *rest)
    latest = keyed.latest_per_key(flat, [*keys], order_by)
    return keyed.to_families(latest, "row_key", *rest).select(*rows.columns)


def lookup_orders(
    spark: SparkSession, path: str, keys: list[str], order_by: list[str] | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The current rows of some keys; only the buckets of these keys are opened."""
    texts = [F.lit(str(key)) for key in keys]
    stored = spark.read.parquet(path).where(
        F.col("bucket").isin([bucket_of(text, buckets) for text in texts])
        & F.col("row_key").isin(texts))
    return latest_orders(stored, order_by)


def compact_orders(
    spark: SparkSession, path: str, new_path: str, order_by: list[str] | None = None
) -> None:
    """Rewrite the log of batches as one batch without outdated rows, in a new folder.

    Run it between two runs of the upsert job and give the job the new folder; positions tell
    which row is the last one, so a repeated batch changes nothing. Each bucket becomes a file
    or some, sorted by key, so a lookup skips most row groups. A bucket holds each key once,
    so no bucket is hot. Rows move once: in ranges of bucket and key, in which the latest are found
    and written.
    """
    order = ["bucket", "row_key"]
    rows = latest_orders(
        spark.read.parquet(path).repartitionByRange(*order), order_by, order)
    (
        rows.withColumn("stored_at", F.current_timestamp()).sortWithinPartitions(*order)
        .write.mode("overwrite").option("compression", CODEC).partitionBy("bucket")
        .parquet(f"{new_path}/run_id={COMPACTED}/batch_id=0")
    )


def create_orders_table(spark: SparkSession, name: str, path: str) -> None:
    """Register what the upsert job writes for SQL: the table `name` with one current row per
    key, and the table function `name_of(key)`, which opens one bucket. Does nothing if both are
    there; the folder may be empty, compacted or not."""
    keyed.create_keyed_table(spark, name, path)
    keyed.create_lookup(spark, f"{name}_of", path, BUCKETS)


def save_bucketed(
    rows: DataFrame, name: str, path: str, key: str = "row_key", buckets: int = BUCKETS
) -> None:
    """Rows as a catalog table in buckets of a key, sorted within. Tables bucketed alike are
    joined and grouped by the key where they lie, without a shuffle. Every task gets whole
    buckets, so a bucket is one file; a key that holds a large part of the rows belongs into a
    table by another key."""
    (
        rows.repartition(buckets, key).write.mode("overwrite").option("path", path)
        .option("compression", CODEC)
        .bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    )


# The feed ------------------------------------------------------------------------------

def recent_sink(
    path: str, key: str, order: list[str], size: int = recent.BUFFER_SIZE
) -> BatchWriter:
    """The last `size` rows per key over all batches and runs so far.

    Two versions are kept, in two folders that take turns: the newer one is what counts, and
    the older one is what a batch that failed half way starts from again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, run_id(batch)
        versions = recent_versions(spark, path)
        rows, slot = batch, 0
        if versions:
            slot = 1 - versions[0].slot
            if (versions[0].run_id, versions[0].batch_id) == (run, batch_id):
                return
            earlier = spark.read.parquet(f"{path}/slot={versions[0].slot}")
            rows = earlier.drop("run_id", "batch_id", "stored_at").unionByName(batch)
        kept = recent.last_per_key(rows, key, order, size).withColumns({
            "run_id": F.lit(run), "batch_id": F.lit(batch_id).cast("long"),
            "stored_at": F.current_timestamp()})
        kept.write.mode("overwrite").parquet(f"{path}/slot={slot}")

    return write


_VERSION_SCHEMA = "run_id string, batch_id long, stored_at timestamp"


def recent_versions(spark: SparkSession, path: str) -> list:
    """What the folders of `recent_sink` hold, newest first: slot, run_id, batch_id."""
    found = []
    for slot in (0, 1):
        if exists(spark, f"{path}/slot={slot}/_SUCCESS"):
            # All rows of a slot tell the same.
            row = spark.read.schema(_VERSION_SCHEMA).parquet(f"{path}/slot={slot}").first()
            found += [Row(slot=slot, **row.asDict())] if row else []
    return sorted(found, key=lambda version: version.stored_at, reverse=True)


def recent_rows(spark: SparkSession, path: str) -> DataFrame:
    """The last rows per key as they stand."""
    versions = recent_versions(spark, path)
    if not versions:
        raise ValueError(f"nothing stored in {path}")
    return spark.read.parquet(f"{path}/slot={versions[0].slot}").drop(
        "run_id", "batch_id", "stored_at")


def _at_once(batch: DataFrame, writes: Sequence[Callable[[], None]]) -> None:
    """Independent writes of a batch side by side: those of a small one mostly wait for the driver.
    Raises the first error once all have ended."""
    with ThreadPoolExecutor(len(writes)) as threads:
        started = [threads.submit(inheritable_thread_target(batch.sparkSession)(write))
                   for write in writes]
    for one in started:
        one.result()


def feed_sink(path: str, order: list[str]) -> BatchWriter:
    """Messages, errors and the last messages per metric, from one reading of a batch."""
    feed, errors = rows_sink(f"{path}/feed"), rows_sink(f"{path}/errors")
    last = recent_sink(f"{path}/recent", "metric", order)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            wanted = batch.where(~readside.is_error() & readside.has_metric())
            _at_once(batch, [
                lambda: feed(wanted, batch_id),
                lambda: errors(batch.where(readside.is_error()), batch_id),
                lambda: last(wanted, batch_id)])
        finally:
            batch.unpersist()

    return write
