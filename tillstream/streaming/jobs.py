"""The streaming jobs. Each start function wires a topic, an operator and a sink.

The same job runs in two ways: `DRAIN` takes what has arrived since the last run and stops,
for a schedule; `LIVE` keeps going. The checkpoint folder is what makes the next run go on
where the last one ended, so every job needs one.

`partitions` is the number of shuffle and state partitions of a job, by default that of the
session. The first start fixes it for good, so it should suit the cluster: the number of its
cores is a good choice. Streams are not re-planned at run time, so too many partitions cost
one task and one small file each, in every batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillstream.functions.fields import event_time
from tillstream.operators import metrics, readside, rejects, sketches
from tillstream.operators.keyed import has_key
from tillstream.operators import keyed
from tillstream.operators.parse import (
    as_variants, parse_orders, unread_numbers, wire_lines,
)
from tillstream.operators.prepare import prepare_streams, with_types
from tillstream.session import CHANGELOG, CLOSE_STATE, DROP_SHUFFLES, SETTINGS, STATE_PROVIDER
from tillstream.sources.csv_files import read_csv, stream_csv
from tillstream.sources.topics import ARRIVAL, Topic
from tillstream.streaming import keyed_source, recent_state, sinks

DRAIN = {"availableNow": True}
LIVE = {"processingTime": "2 seconds"}


@dataclass(frozen=True)
class Run:
    """How a job runs. `limit` caps the files (folder topic) or messages (Kafka) per batch.
    `money` is the type prices are read as; a decimal makes sums exact for prices that fit it."""

    checkpoint: str
    trigger: dict
    limit: int | None = None
    partitions: int | None = None
    money: T.DataType = T.DoubleType()


def _start(
    rows: DataFrame, mode: str, write: sinks.BatchWriter, run: Run, name: str
) -> StreamingQuery:
    writer = rows.writeStream.outputMode(mode).queryName(name).foreachBatch(write)
    return writer.option("checkpointLocation", f"{run.checkpoint}/{name}").trigger(
        **run.trigger).start()


def _own_session(spark: SparkSession, run: Run) -> SparkSession:
    """A session of the job's own: a query copies its settings when it starts, and those of
    the caller's session stay as they are."""
    own = spark.newSession()
    for name in (*SETTINGS, "spark.sql.shuffle.partitions"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    if run.partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(run.partitions))
    return own


def _lines(
    spark: SparkSession, orders: Topic, run: Run, fields: Sequence[str]
) -> DataFrame:
    """Typed lines. The progress reports of the query carry the number of messages, of those
    that are no JSON object, and per number field of values that could not be read as one."""
    messages = orders.stream(_own_session(spark, run), run.limit)
    wire = wire_lines(messages, fields=fields, malformed="__malformed").observe(
        "order_input",
        F.count("*").alias("lines"),
        F.count("__malformed").alias("malformed"),
        *[F.count_if(unread).alias(f"unread_{name}")
          for name, unread in unread_numbers(fields, run.money).items()],
    )
    lines = with_types(wire, run.money)
    return lines.withColumn("timestamp", event_time(F.col("date_"))) if "date_" in fields else lines


def start_metrics(
    spark: SparkSession,
    orders: Topic,
    results: Topic,
    run: Run,
    names: list[str] | None = None,
) -> list[StreamingQuery]:
    """One query per metric, each publishing its whole table after every batch. Every query
    reads and parses all messages; `start_metrics_one_pass` does so once."""
    queries = []
    for name in names or list(metrics.METRICS):
        metric = metrics.METRICS[name]
        lines = _lines(spark, orders, run, metric.fields)
        queries.append(_start(
            metric.totals(lines), "complete", sinks.metric_sink(results, metric), run, name))
    return queries


def start_metrics_one_pass(
    spark: SparkSession,
    orders: Topic,
    results: Topic,
    run: Run,
) -> list[StreamingQuery]:
    """The same result with one query: messages are read and parsed once, not nine times."""
    totals = metrics.compute_all(_lines(spark, orders, run, metrics.fields_of()))
    return [_start(totals, "complete", sinks.one_pass_sink(results), run, "one_pass")]


def start_metric_changes(
    spark: SparkSession,
    orders: Topic,
    path: str,
    run: Run,
) -> StreamingQuery:
    """All metrics as totals of which each batch stores only the keys that its lines changed.

    What is written grows with the new lines, not with the customers and windows so far. Read
    it with `sinks.current_totals` and `metrics.pick`, which ranks and divides;
    `sinks.compact_totals` folds the batches of a run into one.

    A run with a new checkpoint reads the topic anew and has smaller totals until it has caught
    up. `finish_changes` and `run_until_any_ends` record when it has, and from then on, not
    before, its totals are the current ones."""
    totals = metrics.compute_all(_lines(spark, orders, run, metrics.fields_of()))
    return _start(totals, "update", sinks.rows_sink(path, "key_set"), run, "metric_changes")


def start_bounded_trend(
    spark: SparkSession,
    orders: Topic,
    path: str,
    run: Run,
    lateness: str,
) -> StreamingQuery:
    """The sales trend with bounded state: a window is dropped from the state once `lateness`
    has passed, and lines that come even later do not count. Only changed windows are
    written. Off by default elsewhere, because the plain trend counts late lines."""
    metric = metrics.METRICS["sales_trend"]
    lines = _lines(spark, orders, run, metric.fields)
    trend = metric.compute(lines.withWatermark("timestamp", lateness))
    return _start(trend, "update", sinks.rows_sink(path), run, "bounded_trend")


def start_trend(
    spark: SparkSession,
    orders: Topic,
    path: str,
    run: Run,
    lateness: str,
) -> StreamingQuery:
    """The sales trend without state, whose late lines are kept: `sinks.restate_trend` adds them
    to their closed windows, and `sinks.stored_trend` reads the windows. Lines without an event
    time have no window; the progress reports count them."""
    metric = metrics.METRICS["sales_trend"]
    lines = _lines(spark, orders, run, metric.fields).observe(
        "trend_input", F.count_if(F.col("timestamp").isNull()).alias("without_time"))
    timed = lines.where(F.col("timestamp").isNotNull())
    return _start(timed, "append", sinks.trend_sink(path, metric, lateness), run, "trend")


def start_best(
    spark: SparkSession,
    orders: Topic,
    path: str,
    run: Run,
    name: str,
) -> StreamingQuery:
    """A top list that is kept up incrementally: exact, but a batch writes and ranks only what it
    changed. Read it with `sinks.current_best`."""
    metric = metrics.METRICS[name]
    if not metric.top_by:
        raise ValueError(f"{name} is no top list")
    totals = metric.totals(_lines(spark, orders, run, metric.fields))
    return _start(totals, "update", sinks.best_sink(path, metric), run, name)


def start_upsert(
    spark: SparkSession,
    orders: Topic,
    path: str,
    run: Run,
    key: str = "order_id",
    order_by: list[str] | None = None,
) -> StreamingQuery:
    """Orders into the keyed table, as the text they were sent as.

    The progress reports of the query carry the number of lines and of lines without a key,
    counted while the batch is written.
    """
    stream = orders.stream(_own_session(spark, run), run.limit)
    messages = stream.withColumn("position", F.struct(*ARRIVAL))
    lines = wire_lines(messages, ("position",)).observe(
        "upsert_input",
        F.count("*").alias("lines"),
        F.count_if(~has_key(key)).alias("without_key"),
    )
    write = sinks.upsert_sink(path, key, order_by)
    return _start(lines, "append", write, run, "upsert_orders")


def start_preparation(
    spark: SparkSession,
    sales: str,
    products: str,
    path: str,
    run: Run,
    wait: str = "30 days",
) -> StreamingQuery:
    """Raw sales and product files to complete order rows as the files arrive, in any order. Both
    folders must hold a file when the job first starts: their headers name the columns."""
    own = _own_session(spark, run)
    # In a batch without files of one side the planner takes other columns for never NULL, and the
    # check of the state's layout would refuse that difference.
    own.conf.set("spark.sql.streaming.stateStore.stateSchemaCheck", "false")
    # The state holds whole sales: on disk, however little memory the caller's session gives it.
    for name, value in CLOSE_STATE.items():
        own.conf.set(name, value)
    own.conf.set(DROP_SHUFFLES, "true")  # those of a batch, which hold its sales once more
    sides = [stream_csv(own, folder, read_csv(own, folder).columns) for folder in (sales, products)]
    return (
        prepare_streams(*sides, wait).writeStream.outputMode("append").queryName("prepare")
        .format("parquet").option("compression", sinks.CODEC)
        .option("checkpointLocation", f"{run.checkpoint}/prepare")
        .trigger(**run.trigger).start(path)
    )


def start_checked(
    spark: SparkSession,
    orders: Topic,
    path: str,
    run: Run,
    key: str | None = "order_id",
) -> StreamingQuery:
    """Messages into `verdict=kept` and `verdict=rejected`, the latter with all reasons, in one
    pass. Rejected ones keep their text, so that they can be mended and sent again."""
    messages = orders.stream(_own_session(spark, run), run.limit)
    judged = rejects.judge_messages(
        messages.withColumn("position", F.struct(*ARRIVAL)), key, money=run.money,
        keep=("position",)).withColumn("verdict", rejects.verdict())
    return _start(judged, "append", sinks.rows_sink(path, "verdict"), run, "checked")


def start_sketches(
    spark: SparkSession,
    results: Topic,
    path: str,
    run: Run,
    metric: str = "aov_by_customer",
    measure: str = "average_order_value",
) -> StreamingQuery:
    """A sketch of a measure's distribution per snapshot of a metric. A snapshot that comes in two
    batches has two, which merge like any others."""
    messages = results.stream(_own_session(spark, run), run.limit)
    rows = readside.result_rows(messages, [measure]).where(F.col("metric") == metric).select(
        "run_id", "epoch_id", measure)

    def write(batch: DataFrame, batch_id: int) -> None:
        found = sketches.sketch(batch, ["run_id", "epoch_id"], measure).withColumnRenamed(
            "run_id", "result_run")
        store(found, batch_id)

    store = sinks.rows_sink(path)
    return _start(rows, "append", write, run, "sketches")


def start_keyed_source(
    spark: SparkSession,
    orders: Topic,
    path: str,
    run: Run,
    key: str = "order_id",
) -> StreamingQuery:
    """Orders into the keyed table through the sink of `keyed_source`, which commits or aborts
    each batch as a whole. No batch callback: tasks write what they hold, without a shuffle, and
    reading keeps the last row of each key (`committed_rows`, `sinks.latest_orders`)."""
    # In the caller's session, which knows the sink; there is no shuffle to have settings of its own.
    keyed_source.register(spark)
    messages = orders.stream(spark, run.limit).withColumn("position", F.struct(*ARRIVAL))
    lines = wire_lines(messages, ("position",)).observe(
        "upsert_input",
        F.count("*").alias("lines"),
        F.count_if(~has_key(key)).alias("without_key"),
    )
    rows = keyed.to_families(lines.where(has_key(key)), key, "position")
    checkpoint = f"{run.checkpoint}/keyed_source"
    return (
        rows.writeStream.outputMode("append").queryName("keyed_source")
        .format(keyed_source.NAME)
        .option("path", path).option("run", keyed_source.run_name(checkpoint))
        .option("checkpointLocation", checkpoint)
        .trigger(**run.trigger).start()
    )


def start_variant_landing(
    spark: SparkSession,
    orders: Topic,
    path: str,
    run: Run,
) -> StreamingQuery:
    """Every message as a document of any shape: parsed once, on landing, into a variant that
    is read by path (`parse.variant_lines`). No field is left out, as no schema is closed; `raw`
    holds the text of messages that are no JSON, and is NULL for the others."""
    messages = orders.stream(_own_session(spark, run), run.limit).withColumn(
        "source", F.struct("topic", *ARRIVAL))
    documents = as_variants(messages, ("source",)).withColumn(
        "ingested_at", F.current_timestamp()).observe(
        "landed", F.count("*").alias("messages"), F.count("raw").alias("malformed"))
    return (
        documents.writeStream.outputMode("append").queryName("land_variants")
        .format("parquet").option("compression", sinks.CODEC)
        .option("checkpointLocation", f"{run.checkpoint}/land_variants")
        .trigger(**run.trigger)
        .start(path)
    )


def start_landing(
    spark: SparkSession,
    orders: Topic,
    path: str,
    run: Run,
    sink_format: str = "parquet",
    options: dict[str, str] | None = None,
) -> StreamingQuery:
    """Every message as a document: its text, its fields, whether it is `malformed` (no JSON
    object) and where it came from.

    The file sink of Spark itself commits each message once. `sink_format` and `options`
    address a document store instead, if its connector is on the class path.
    """
    messages = orders.stream(_own_session(spark, run), run.limit).withColumns({
        "raw": F.col("value").cast("string"),
        "source": F.struct("topic", *ARRIVAL),
    })
    documents = parse_orders(
        messages, run.money, keep=("raw", "source"), malformed="malformed").withColumns({
        "malformed": F.col("malformed").isNotNull(), "ingested_at": F.current_timestamp(),
    }).observe("landed", F.count("*").alias("messages"),
               F.count_if("malformed").alias("malformed"))
    return (
        documents.writeStream.outputMode("append").queryName("land_orders")
        .format(sink_format)
        .options(**({"compression": sinks.CODEC} if sink_format == "parquet" else {}))
        .options(**(options or {}))
        .option("checkpointLocation", f"{run.checkpoint}/land_orders")
        .trigger(**run.trigger)
        .start(path)
    )


def _once_each(messages: DataFrame, within: str) -> DataFrame:
    """The messages without repeats. The state holds what was read during the last `within`.

    The clock is the time of reading, kept with each batch: unlike the time a message was sent
    it never goes back, so no message is taken for a late one and lost."""
    read = messages.withColumns({
        "__identity": readside.identity(), "__read_at": F.current_timestamp()})
    return read.withWatermark("__read_at", within).dropDuplicatesWithinWatermark(
        ["__identity"]).select(*messages.columns)


def start_recent(
    spark: SparkSession,
    results: Topic,
    path: str,
    run: Run,
    schema: T.StructType,
    order: list[str] | None = None,
    repeats_within: str | None = "1 day",
    expire_ms: int | None = None,
) -> StreamingQuery:
    """The last messages of every metric, kept as state of the stream. A batch stores the lists
    it changed; read them with `recent_state.stored_last_messages`. A list that gets no message
    for `expire_ms` leaves the state and is filled anew by the next one."""
    own = _own_session(spark, run)
    # Lists as state are only in RocksDB, whatever the caller's session keeps its state in.
    own.conf.set(STATE_PROVIDER, SETTINGS[STATE_PROVIDER])
    if expire_ms:  # a clock would keep a draining run going on batches without data for ever
        own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    messages = results.stream(own, run.limit)
    if repeats_within:
        messages = _once_each(messages, repeats_within)
    rows = readside.feed_rows(messages, schema)
    wanted = rows.where(readside.has_metric() & ~readside.is_error())
    lists = recent_state.last_messages(
        wanted, "metric", order or ["position"], expire_ms=expire_ms)
    return _start(lists, "append", sinks.rows_sink(path), run, "recent")


def start_feed(
    spark: SparkSession,
    results: Topic,
    path: str,
    run: Run,
    schema: T.StructType,
    order: list[str] | None = None,
    repeats_within: str | None = "1 day",
) -> StreamingQuery:
    """The live feed of result messages: `feed` takes every message with a metric, `errors`
    the error messages, and `recent` holds the last messages of every metric. Messages with
    neither metric nor error are left out. `order` tells which messages are the last ones;
    by default the order of arrival. One query reads the topic and writes all three. The run that
    a message names is in `message_run_id`, next to `run_id`, the run that stored it.

    A message that the log holds twice is taken once, if it is read again within
    `repeats_within`; None turns that off."""
    own = _own_session(spark, run)
    # The state holds every message of the last day, whatever the caller's session keeps it in.
    for name in (STATE_PROVIDER, CHANGELOG):
        own.conf.set(name, SETTINGS[name])
    messages = results.stream(own, run.limit)
    if repeats_within:
        messages = _once_each(messages, repeats_within)
    rows = sinks.beside_own(readside.feed_rows(messages, schema))
    rows = rows.observe(
        "feed_input", F.count("*").alias("messages"),
        F.count_if(readside.is_error()).alias("errors"),
        F.count_if(~readside.has_metric() & ~readside.is_error()).alias("without_metric"))
    return _start(rows, "append", sinks.feed_sink(path, order or ["position"]), run, "feed")


def finish(queries: list[StreamingQuery]) -> None:
    """Wait until every draining query has stopped; raises if one failed."""
    for query in queries:
        query.awaitTermination()


def finish_changes(spark: SparkSession, query: StreamingQuery, path: str) -> None:
    """Wait until a draining `start_metric_changes` has stopped. It has then read all there was
    when it started, so its totals become the current ones."""
    query.awaitTermination()
    sinks.hand_over(spark, path, str(query.id))


def _has_caught_up(query: StreamingQuery) -> bool:
    """Has a live query been through some data and found no more?"""
    progress = query.lastProgress
    waiting = query.status["isDataAvailable"] or query.status["isTriggerActive"]
    return progress is not None and not waiting


def run_until_any_ends(
    spark: SparkSession, queries: list[StreamingQuery], totals: list[str] | None = None
) -> None:
    """Keep live queries running; when the first one ends or fails, so does the job. `totals` are
    the folders of the queries if these keep totals, which become the current ones once their
    query has caught up with the topic."""
    behind = list(zip(queries, totals or []))
    try:
        while all(query.isActive for query in queries):
            queries[0].awaitTermination(1)
            for query, path in [pair for pair in behind if _has_caught_up(pair[0])]:
                sinks.hand_over(spark, path, str(query.id))
                behind.remove((query, path))
    finally:
        for query in queries:
            query.stop()
    for query in queries:
        if query.exception() is not None:
            raise query.exception()
