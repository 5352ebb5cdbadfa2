"""Inputs the registered queries need beyond the tables, derived from the tables by Spark.

Files, topics and job results are made once per session and data folder, in the shared
working folder, from all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.operators import keyed, readside
from tillstream.operators.metrics import METRICS
from tillstream.schema import EXACT_MONEY, FIELD_NAMES, RESULT_SCHEMA, RESULT_TOPIC
from tillstream.session import work_folder
from tillstream.sources import star
from tillstream.sources.csv_files import read_csv, write_csv
from tillstream.sources.topics import (
    FolderTopic, newest_snapshots, order_folder, order_payload, result_folder,
)
from tillstream.streaming import jobs, sinks

# Orders reach the topic in two deliveries: the first holds the lines of the orders with keys
# below the middle between the smallest and the largest.

_made: dict[tuple[str, str, str], str] = {}
_making = RLock()  # making one thing may need another


def _once(
    spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], None]
) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _making:
        if key not in _made:
            path = work_folder(spark, name)
            make(path)
            _made[key] = path
    return _made[key]


def _publish(topic: FolderTopic, lines: DataFrame) -> None:
    topic.append(lines.select(order_payload(lines).alias("value")))


_PARTS = ("first", "second")


def _deliveries(spark: SparkSession, sf_dir: str) -> list[FolderTopic]:
    """The order topic as it is after the first delivery and after both. A job that goes on with
    its checkpoint takes of the later one what it has not seen, so no job needs a copy."""
    path = _order_parts(spark, sf_dir)
    return [order_folder(f"{path}/{_PARTS[0]}"), order_topic(spark, sf_dir)]


# Raw files -----------------------------------------------------------------------------

_PRODUCT_FIELDS = (
    "product_name", "unit", "product_type", "brand_name",
    "l0_category", "l1_category", "l2_category",
    "l0_category_id", "l1_category_id", "l2_category_id",
)


# CSV as an export tool leaves it: with index columns, and with missing values (no discount, units
# of size 1) written as NA or blank.

def raw_sales(spark: SparkSession, sf_dir: str) -> str:
    def make(path: str) -> None:
        sale_fields = [name for name in FIELD_NAMES if name not in _PRODUCT_FIELDS]
        sales = star.order_lines(spark, sf_dir, *sale_fields).select(
            F.monotonically_increasing_id().alias("Unnamed: 0"),
            F.monotonically_increasing_id().alias("Unnamed: 0.1"),
            *[F.col(name).cast("string").alias(name) for name in sale_fields],
        )
        no_discount = F.col("total_discount_amount").cast("decimal(18,4)") == 0
        sales = sales.withColumn(
            "total_discount_amount",
            F.when(no_discount, "NA").otherwise(F.col("total_discount_amount")),
        )
        write_csv(sales, path, packed=True)

    return _once(spark, sf_dir, "raw_sales", make)


def raw_products(spark: SparkSession, sf_dir: str) -> str:
    def make(path: str) -> None:
        kind = F.split_part("p_name", F.lit(" "), F.lit(2))
        products = star.table(spark, sf_dir, "part").select(
            F.monotonically_increasing_id().alias("Unnamed: 0"),
            F.monotonically_increasing_id().alias("Unnamed: 0.2"),
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.when(F.col("p_size") != 1, F.col("p_size").cast("string")).alias("unit"),
            kind.alias("product_type"),
            F.col("p_brand").alias("brand_name"),
            kind.alias("l0_category"),
            F.col("p_type").alias("l1_category"),
            F.col("p_name").alias("l2_category"),
            F.col("p_size").alias("l0_category_id"),
            F.col("p_size").alias("l1_category_id"),
            F.col("p_partkey").alias("l2_category_id"),
        )
        write_csv(products, path, packed=True)

    return _once(spark, sf_dir, "raw_products", make)


def prepared_stream(spark: SparkSession, sf_dir: str) -> str:
    """Order rows prepared as their files arrived: all sales with the products of even numbers
    first, then the other products, for which their sales had to wait."""

    def make(path: str) -> None:
        sales, products = raw_sales(spark, sf_dir), read_csv(spark, raw_products(spark, sf_dir))
        even = F.coalesce(F.col("product_id").cast("long") % 2 == 0, F.lit(True))
        for part in (even, ~even):
            write_csv(products.where(part), f"{path}/products", "append", packed=True)
            jobs.finish([jobs.start_preparation(
                spark, sales, f"{path}/products", f"{path}/rows", _drain(spark, path))])

    return f"{_once(spark, sf_dir, 'preparation_job', make)}/rows"


# Topics --------------------------------------------------------------------------------

def _order_parts(spark: SparkSession, sf_dir: str) -> str:
    def make(path: str) -> None:
        lines = star.order_lines(spark, sf_dir)
        ends = star.table(spark, sf_dir, "lineitem").agg(
            (F.min("l_orderkey") + F.max("l_orderkey")).alias("x")).first().x
        early = F.coalesce(2 * F.col("order_id") < F.lit(ends), F.lit(False))
        for name, part in zip(_PARTS, (early, ~early)):
            _publish(order_folder(f"{path}/{name}"), lines.where(part))

    return _once(spark, sf_dir, "order_topic", make)


def order_topic(spark: SparkSession, sf_dir: str) -> FolderTopic:
    """All order lines as messages, each delivery in a folder. The jobs read this one topic, or
    parts of it."""
    return order_folder(f"{_order_parts(spark, sf_dir)}/{{{','.join(_PARTS)}}}")


FEED_SCHEMA = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("value", T.DoubleType()),
])


def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as result messages: errors carry an `error`, sign-ups no metric, the others
    their type as metric."""
    kind = F.col("event_type")
    return star.table(spark, sf_dir, "events").select(
        F.when(~kind.isin("error", "signup"), kind).alias("metric"),
        F.when(kind == "error", F.col("props")).alias("error"),
        "event_id", "user_id", "value",
    )


def feed_topic(spark: SparkSession, sf_dir: str) -> FolderTopic:
    def make(path: str) -> None:
        rows = feed_rows(spark, sf_dir)
        FolderTopic(path, RESULT_TOPIC).append(
            rows.select(F.to_json(F.struct("*")).alias("value")))

    return FolderTopic(_once(spark, sf_dir, "feed_topic", make), RESULT_TOPIC)


# Job results ---------------------------------------------------------------------------

def _drain(spark: SparkSession, path: str, files_per_core: int | None = None) -> jobs.Run:
    """A draining run for this cluster. Jobs that shuffle whole rows take a backlog in
    batches of some files per core; the metric jobs shuffle totals only and take it at once."""
    cores = spark.sparkContext.defaultParallelism
    return jobs.Run(
        f"{path}/checkpoints", jobs.DRAIN, files_per_core and files_per_core * cores,
        partitions=cores, money=EXACT_MONEY)


def _two_runs(spark: SparkSession, sf_dir: str, name: str, start: Callable) -> str:
    """Folder of what a metric job leaves that is run after each of the two deliveries."""

    def make(path: str) -> None:
        for orders in _deliveries(spark, sf_dir):
            found = start(orders, path)
            jobs.finish(found if isinstance(found, list) else [found])

    return _once(spark, sf_dir, name, make)


def metric_results(spark: SparkSession, sf_dir: str) -> FolderTopic:
    """Result log of the nine metric streams: epoch 0 after the first delivery, epoch 1 after
    both."""
    path = _two_runs(spark, sf_dir, "metric_job", lambda orders, path: jobs.start_metrics(
        spark, orders, result_folder(f"{path}/results"), _drain(spark, path)))
    return result_folder(f"{path}/results")


def one_pass_results(spark: SparkSession, sf_dir: str) -> FolderTopic:
    path = _two_runs(spark, sf_dir, "one_pass_job", lambda orders, path: (
        jobs.start_metrics_one_pass(
            spark, orders, result_folder(f"{path}/results"), _drain(spark, path))))
    return result_folder(f"{path}/results")


def changed_totals(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the totals that each of the two deliveries changed."""
    path = _two_runs(spark, sf_dir, "changes_job", lambda orders, path: (
        jobs.start_metric_changes(spark, orders, f"{path}/totals", _drain(spark, path))))
    return f"{path}/totals"


def results_after_new_checkpoint(spark: SparkSession, sf_dir: str) -> FolderTopic:
    """Result log of a one-query job that ran over the first delivery, and then over all of the
    topic with a new checkpoint: both runs publish an epoch 0."""

    def make(path: str) -> None:
        for n, orders in enumerate(_deliveries(spark, sf_dir)):
            jobs.finish(jobs.start_metrics_one_pass(
                spark, orders, result_folder(f"{path}/results"),
                _drain(spark, f"{path}/run{n}")))

    return result_folder(f"{_once(spark, sf_dir, 'new_checkpoint_metric_job', make)}/results")


def repeated_results(spark: SparkSession, sf_dir: str) -> FolderTopic:
    """A log that is only appended to, as a broker keeps it, in which the last snapshot of the
    one-query job was sent twice."""

    def make(path: str) -> None:
        results = one_pass_results(spark, sf_dir)
        messages = results.replay(spark)
        for _ in range(2):
            FolderTopic(path, RESULT_TOPIC).append(messages.where(readside.is_newest(
                messages, newest_snapshots(results, spark))))

    return FolderTopic(_once(spark, sf_dir, "repeated_results", make), RESULT_TOPIC)


def best_lists(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder of a top list that was kept up over the two deliveries."""
    path = _two_runs(spark, sf_dir, f"{name}_best_job", lambda orders, path: jobs.start_best(
        spark, orders, f"{path}/best", _drain(spark, path), name))
    return f"{path}/best"


def trend_with_late_lines(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the trend of events that arrive in the wrong order, the later half of the time
    first, so that the other half is late; corrected once between and once at the end."""

    def make(path: str) -> None:
        events = order_folder(f"{path}/events")
        lines = star.event_lines(spark, sf_dir)
        time = F.unix_seconds("timestamp")
        low, high = lines.agg(F.min(time), F.max(time)).first()
        middle = ((low or 0) + (high or 0)) // 2
        first, quarter = time >= middle, time >= (3 * (low or 0) + (high or 0)) // 4
        for part in (first, ~first & quarter, ~first & ~quarter):
            _publish(events, lines.where(part).drop("timestamp"))
            jobs.finish([jobs.start_trend(
                spark, events, f"{path}/trend", _drain(spark, path), "1 hour")])
            sinks.restate_trend(spark, f"{path}/trend", METRICS["sales_trend"])

    return f"{_once(spark, sf_dir, 'late_trend_job', make)}/trend"


def foreign_results(spark: SparkSession, sf_dir: str) -> FolderTopic:
    """An append-only log with messages that no job of this package sent, each batch sent twice:
    a metric keyed by a field of its own, errors, and fields named like columns of a topic. The
    run that sent them is named, but they have no message id."""

    def make(path: str) -> None:
        kind = F.col("event_type")
        envelope = [F.lit("other").alias("run_id"), F.lit(3).alias("epoch_id")]
        events = star.table(spark, sf_dir, "events")
        metric = events.where(kind == "purchase").select(F.to_json(F.struct(
            F.lit("purchases_by_event").alias("metric"), *envelope, "event_id", "value",
            F.concat(F.lit("t"), F.col("user_id")).alias("topic"),
            (F.col("event_id") % 7).alias("partition"), F.col("user_id").alias("offset"),
            kind.alias("key"))).alias("value"))
        errors = events.where(kind == "error").select(F.to_json(F.struct(
            *envelope, F.concat(F.lit("e"), F.col("event_id")).alias("error"))).alias("value"))
        for _ in range(2):
            FolderTopic(path, RESULT_TOPIC).append(metric.union(errors))

    return FolderTopic(_once(spark, sf_dir, "foreign_results", make), RESULT_TOPIC)


def mixed_topic(spark: SparkSession, sf_dir: str) -> FolderTopic:
    """Events as messages of several makers: purchases are orders with a price, with a price in
    words for every tenth user, errors are plain text, and the others JSON of fields unknown to
    the jobs."""

    def make(path: str) -> None:
        kind = F.col("event_type")
        price = F.when(F.col("user_id") % 10 == 0, "ten").otherwise(
            F.col("value").cast("string"))
        body = F.when(kind == "error", F.concat(F.lit("failed: "), F.col("event_id"))).when(
            kind == "purchase", F.to_json(F.struct(
                F.col("event_id").cast("string").alias("order_id"),
                price.alias("unit_selling_price"))))
        other = F.to_json(F.struct(
            kind.alias("metric"), "event_id", F.col("user_id").alias("customer"),
            F.struct(F.col("value").alias("amount")).alias("details")))
        order_folder(path).append(star.table(spark, sf_dir, "events").select(
            F.coalesce(body, other).alias("value")))

    return order_folder(_once(spark, sf_dir, "mixed_topic", make))


def checked_messages(spark: SparkSession, sf_dir: str) -> str:
    """Messages of several makers, kept or rejected."""

    def make(path: str) -> None:
        jobs.finish([jobs.start_checked(
            spark, mixed_topic(spark, sf_dir), f"{path}/checked", _drain(spark, path, 8))])

    return f"{_once(spark, sf_dir, 'checked_job', make)}/checked"


def aov_sketches(spark: SparkSession, sf_dir: str) -> str:
    """Sketches of the customers' mean order values, one per snapshot of the one-query job."""

    def make(path: str) -> None:
        jobs.finish([jobs.start_sketches(
            spark, one_pass_results(spark, sf_dir), f"{path}/sketches", _drain(spark, path))])

    return f"{_once(spark, sf_dir, 'sketch_job', make)}/sketches"


def keyed_orders(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the keyed table after the upsert job has taken all order lines. The last
    line of an order is the one with the highest field values, so that SQL can tell it too."""

    def make(path: str) -> None:
        jobs.finish([jobs.start_upsert(
            spark, order_topic(spark, sf_dir), f"{path}/table", _drain(spark, path, 8),
            order_by=list(FIELD_NAMES))])

    return f"{_once(spark, sf_dir, 'upsert_job', make)}/table"


def keyed_orders_after_new_checkpoint(spark: SparkSession, sf_dir: str) -> str:
    """The same table from two jobs, each with its own checkpoint and half of the topic."""

    def make(path: str) -> None:
        for n, part in enumerate(_PARTS):
            orders = order_folder(f"{_order_parts(spark, sf_dir)}/{part}")
            jobs.finish([jobs.start_upsert(
                spark, orders, f"{path}/table", _drain(spark, f"{path}/run{n}", 8),
                order_by=list(FIELD_NAMES))])

    return f"{_once(spark, sf_dir, 'new_checkpoint_upsert_job', make)}/table"


def compacted_orders(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, sf_dir, "compaction", lambda path: sinks.compact_orders(
        spark, keyed_orders_after_new_checkpoint(spark, sf_dir), path, list(FIELD_NAMES)))


def restated_orders(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the keyed table, as the upsert job leaves it, after every order was sent twice:
    first with a city that is not known, in a second delivery as it is."""

    def make(path: str) -> None:
        orders = order_folder(f"{path}/orders")
        keyed.upsert(star.order_lines(spark, sf_dir)).select(*keyed.family_fields()).write.option(
            "compression", sinks.CODEC).parquet(f"{path}/lines")  # joined once, published twice
        table = spark.read.parquet(f"{path}/lines")
        for lines in (table.withColumn("city_name", F.lit("unknown")), table):
            _publish(orders, lines)
            jobs.finish([jobs.start_upsert(
                spark, orders, f"{path}/table", _drain(spark, path, 8))])

    return f"{_once(spark, sf_dir, 'restated_orders', make)}/table"


def keyed_source(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the keyed table that the sink with commits filled, in two runs."""

    def make(path: str) -> None:
        for orders in _deliveries(spark, sf_dir):
            jobs.finish([jobs.start_keyed_source(
                spark, orders, f"{path}/table", _drain(spark, path, 8))])

    return f"{_once(spark, sf_dir, 'keyed_source_job', make)}/table"


def bucketed_orders(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Names of two catalog tables, orders and order lines, in buckets of the order."""

    def make(path: str) -> None:
        name = path.rsplit("-", 1)[-1]
        # Dealt to the buckets first, so that the latest rows are found where they will lie.
        stored = spark.read.parquet(keyed_orders(spark, sf_dir)).repartition(
            sinks.BUCKETS, "row_key")
        orders = sinks.latest_orders(stored, list(FIELD_NAMES))
        sinks.save_bucketed(orders.drop("position", "bucket"), f"orders_{name}", f"{path}/orders")
        lines = star.order_lines(spark, sf_dir, "order_id", "procured_quantity").select(
            F.col("order_id").cast("string").alias("row_key"), "procured_quantity")
        sinks.save_bucketed(lines, f"lines_{name}", f"{path}/lines")

    name = _once(spark, sf_dir, "bucketed", make).rsplit("-", 1)[-1]
    return f"orders_{name}", f"lines_{name}"


def landed_variants(spark: SparkSession, sf_dir: str) -> str:
    def make(path: str) -> None:
        jobs.finish([jobs.start_variant_landing(
            spark, order_topic(spark, sf_dir), f"{path}/documents", _drain(spark, path, 8))])

    return f"{_once(spark, sf_dir, 'variant_landing_job', make)}/documents"


PER_FILE = 500


def throttled_batches(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """Folder of the feed of a topic with `PER_FILE` messages per file at most, drained at no
    more than a limit of messages per batch, and that limit."""
    cores = spark.sparkContext.defaultParallelism
    limit = 4 * PER_FILE * cores

    def make(path: str) -> None:
        topic = FolderTopic(f"{path}/topic", RESULT_TOPIC, per_file=PER_FILE)
        topic.append(feed_rows(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")))
        run = jobs.Run(f"{path}/checkpoints", jobs.DRAIN, limit, partitions=cores)
        jobs.finish([jobs.start_feed(
            spark, topic, f"{path}/feed", run, FEED_SCHEMA, order=["event_id"])])

    return f"{_once(spark, sf_dir, 'throttled_job', make)}/feed", limit


def totals_during_rerun(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the changed totals while they are made anew: one run has read both deliveries
    and caught up, a second one with a checkpoint of its own has read the first only."""

    def make(path: str) -> None:
        first, both = _deliveries(spark, sf_dir)
        jobs.finish_changes(spark, jobs.start_metric_changes(
            spark, both, f"{path}/totals", _drain(spark, f"{path}/old")), f"{path}/totals")
        jobs.finish([jobs.start_metric_changes(
            spark, first, f"{path}/totals", _drain(spark, f"{path}/new"))])

    return f"{_once(spark, sf_dir, 'rerun_changes_job', make)}/totals"


def compacted_totals(spark: SparkSession, sf_dir: str) -> str:
    """The changed totals of two deliveries: the first compacted, the second added behind it."""

    def make(path: str) -> None:
        for n, orders in enumerate(_deliveries(spark, sf_dir)):
            jobs.finish_changes(spark, jobs.start_metric_changes(
                spark, orders, f"{path}/totals{n}", _drain(spark, path)), f"{path}/totals{n}")
            if not n:
                sinks.compact_totals(spark, f"{path}/totals0", f"{path}/totals1")

    return f"{_once(spark, sf_dir, 'compact_totals_job', make)}/totals1"


def landed_orders(spark: SparkSession, sf_dir: str) -> str:
    def make(path: str) -> None:
        jobs.finish([jobs.start_landing(
            spark, order_topic(spark, sf_dir), f"{path}/documents", _drain(spark, path, 8))])

    return f"{_once(spark, sf_dir, 'landing_job', make)}/documents"


def bounded_trend(spark: SparkSession, sf_dir: str) -> str:
    """Changed windows per batch of the bounded trend. The events arrive in time order, in
    three deliveries, so none is late."""

    def make(path: str) -> None:
        events = order_folder(f"{path}/events")
        lines = star.event_lines(spark, sf_dir)
        time = F.unix_seconds("timestamp")
        low, high = lines.agg(F.coalesce(F.min(time), F.lit(0)), F.coalesce(
            F.max(time), F.lit(0))).first()
        third = (high - low) // 3
        for start, end in ((low, low + third), (low + third, low + 2 * third),
                           (low + 2 * third, high + 1)):
            part = lines.where((time >= start) & (time < end))
            _publish(events, part.drop("timestamp"))
            jobs.finish([jobs.start_bounded_trend(
                spark, events, f"{path}/trend", _drain(spark, path), "1 hour")])

    return f"{_once(spark, sf_dir, 'trend_job', make)}/trend"


def feed(spark: SparkSession, sf_dir: str) -> str:
    def make(path: str) -> None:
        jobs.finish([jobs.start_feed(
            spark, feed_topic(spark, sf_dir), f"{path}/feed", _drain(spark, path, 8),
            FEED_SCHEMA, order=["event_id"])])

    return f"{_once(spark, sf_dir, 'feed_job', make)}/feed"


def repeated_feed(spark: SparkSession, sf_dir: str) -> str:
    """The feed of an append-only log in which the last snapshot was sent again between two runs
    of the job."""

    def make(path: str) -> None:
        results = one_pass_results(spark, sf_dir)
        messages = results.replay(spark)
        last = messages.where(readside.is_newest(messages, newest_snapshots(results, spark)))
        log = FolderTopic(f"{path}/log", RESULT_TOPIC)
        for _ in range(2):
            log.append(last)
            jobs.finish([jobs.start_feed(
                spark, log, f"{path}/feed", _drain(spark, path, 8), RESULT_SCHEMA)])

    return f"{_once(spark, sf_dir, 'repeated_feed_job', make)}/feed"


def recent_lists(spark: SparkSession, sf_dir: str) -> str:
    """The last messages as state, of the events in two deliveries, each sent twice."""

    def make(path: str) -> None:
        rows = feed_rows(spark, sf_dir)
        topic = FolderTopic(f"{path}/topic", RESULT_TOPIC)
        middle = rows.agg(((F.min("event_id") + F.max("event_id")) / 2)).scalar()
        body = F.to_json(F.struct("*", F.col("event_id").cast("string").alias("message_id")))
        late = F.coalesce(F.col("event_id") >= middle, F.lit(False))
        for part in (~late, late):
            for _ in range(2):
                topic.append(rows.where(part).select(body.alias("value")))
            jobs.finish([jobs.start_recent(
                spark, topic, f"{path}/recent", _drain(spark, path), FEED_SCHEMA, ["event_id"])])

    return f"{_once(spark, sf_dir, 'recent_job', make)}/recent"


def exported_results(spark: SparkSession, sf_dir: str, rows: DataFrame) -> str:
    return _once(spark, sf_dir, "export", lambda path: write_csv(rows, path))
