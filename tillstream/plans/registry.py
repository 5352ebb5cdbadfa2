"""All queries by name, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.operators import (
    keyed, metrics, parse, prepare, readside, recent, rejects, sketches,
)
from tillstream.plans import staging
from tillstream.schema import EXACT_MONEY, FIELD_NAMES
from tillstream.session import work_folder
from tillstream.sources import star
from tillstream.sources.csv_files import read_csv
from tillstream.sources.topics import FolderTopic, newest_snapshots, order_payload
from tillstream.streaming import keyed_source, recent_state, sinks

Query = Callable[[SparkSession, str], DataFrame]
MODES = {"": "latest", "_cumulative": "cumulative"}


def _plain(rows: DataFrame) -> DataFrame:
    """Money as double, windows as two columns, times without zone: comparable anywhere."""
    columns = []
    for f in rows.schema:
        if isinstance(f.dataType, T.DecimalType):
            columns.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            columns.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        elif f.name == "window":
            for end in ("start", "end"):
                columns.append(
                    F.col(f"window.{end}").cast("timestamp_ntz").alias(f"window_{end}"))
        else:
            columns.append(F.col(f.name))
    return rows.select(*columns)


# Metrics over tables -------------------------------------------------------------------

def _metric(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    metric = metrics.METRICS[name]
    return metric.compute(star.order_lines(spark, sf_dir, *_line_fields(metric.fields)))


def _metric_query(name: str) -> Query:
    return lambda spark, sf_dir: _plain(_metric(spark, sf_dir, name))


def sales_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend over events, which have a time of day."""
    return _plain(metrics.METRICS["sales_trend"].compute(star.event_lines(spark, sf_dir)))


def _line_fields(fields: Sequence[str]) -> list[str]:
    """From the tables the event time comes as a time, not as text to be read."""
    return ["timestamp" if field == "date_" else field for field in fields]


def _one_pass(
    spark: SparkSession, sf_dir: str, wanted: Sequence[metrics.Metric]
) -> DataFrame:
    lines = star.order_lines(spark, sf_dir, *_line_fields(metrics.fields_of(wanted)))
    tables = metrics.compute_all_once(lines, work_folder(spark, "totals"), wanted)
    return _plain(metrics.union_of([
        metrics.labelled(metrics.METRICS[name], rows) for name, rows in tables.items()
    ]))


def multi_metric_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight unwindowed metrics in one table."""
    return _one_pass(spark, sf_dir, [m for m in metrics.ALL if not m.per_window])


# Metrics whose totals are of fields that the nine do not combine like that.
_DISCOUNT_ONLY = metrics.METRICS["discount_by_brand"]
_TWO_COUNTS = (
    metrics.METRICS["avg_price_by_category"],
    metrics.Metric("lines_by_category", "l1_category",
                   (metrics.Measure("lines", "count", "procured_quantity"),
                    metrics.Measure("discount", "money", "total_discount_amount"))),
)


def one_pass_discount_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass for a metric without prices."""
    return _one_pass(spark, sf_dir, [_DISCOUNT_ONLY]).drop("metric")


def one_pass_two_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass for two metrics that count and add up different fields of one key."""
    lines = star.order_lines(spark, sf_dir, *_line_fields(metrics.fields_of(_TWO_COUNTS)))
    tables = metrics.compute_all_once(lines, work_folder(spark, "totals"), _TWO_COUNTS)
    average, counted = (tables[m.name] for m in _TWO_COUNTS)
    return average.join(counted, average.l1_category.eqNullSafe(counted.l1_category)).select(
        average.l1_category, "avg_unit_selling_price", "lines", "discount")


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine metrics in one table."""
    return _one_pass(spark, sf_dir, metrics.ALL)


# Preparation, messages, storage --------------------------------------------------------

def prep_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files to typed order lines. No cell holds a line break."""
    raw = [
        read_csv(spark, made(spark, sf_dir)) for made in (staging.raw_sales, staging.raw_products)]
    rows = prepare.prepare(*raw, read=partial(prepare.with_types, money=EXACT_MONEY))
    return _plain(rows.select(*[name for name in FIELD_NAMES if name in rows.columns]))


def prep_sales_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from files that arrived one after another."""
    rows = spark.read.parquet(staging.prepared_stream(spark, sf_dir))
    return _plain(prepare.with_types(rows, EXACT_MONEY))


def publish_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = staging.order_topic(spark, sf_dir).replay(spark)
    return messages.select(F.col("value").cast("string").alias("value"))


def parse_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = staging.order_topic(spark, sf_dir).replay(spark)
    return _plain(parse.parse_orders(messages, EXACT_MONEY))


def parse_orders_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages read strictly: their numbers are quoted, so all of them are NULL."""
    messages = staging.order_topic(spark, sf_dir).replay(spark)
    return _plain(parse.parse_orders(messages, strict=True))


def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = keyed.upsert(star.order_lines(spark, sf_dir))
    return _plain(table.select("row_key", *keyed.family_fields()))


def _orders_in(spark: SparkSession, path: str) -> DataFrame:
    table = sinks.latest_orders(spark.read.parquet(path), order_by=list(FIELD_NAMES))
    return table.select("row_key", *keyed.family_fields())


def upsert_orders_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_in(spark, staging.keyed_orders(spark, sf_dir))


def upsert_orders_new_checkpoint_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed table that two jobs with their own checkpoints filled."""
    return _orders_in(spark, staging.keyed_orders_after_new_checkpoint(spark, sf_dir))


def compacted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.read.parquet(staging.compacted_orders(spark, sf_dir))
    return stored.select("row_key", *keyed.family_fields())


def order_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with the smallest and the largest key, from their buckets alone."""
    ends = star.table(spark, sf_dir, "lineitem").agg(
        F.min("l_orderkey"), F.max("l_orderkey")).first()
    keys = [str(key) for key in ends if key is not None]
    found = sinks.lookup_orders(
        spark, staging.compacted_orders(spark, sf_dir), keys, list(FIELD_NAMES))
    return found.select("row_key", *keyed.family_fields())


def keyed_table_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered table over the compacted folder: one row per order."""
    path = staging.compacted_orders(spark, sf_dir)
    name = "orders_" + path.rsplit("-", 1)[-1]
    keyed.create_keyed_table(spark, name, path)
    return spark.table(name).select("row_key", *keyed.family_fields())


def _restated_table(spark: SparkSession, sf_dir: str) -> str:
    path = staging.restated_orders(spark, sf_dir)
    name = "restated_" + path.split("/")[-2].rsplit("-", 1)[-1]
    sinks.create_orders_table(spark, name, path)
    return name


def keyed_table_restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered table over a folder that is not compacted and holds every order twice."""
    return spark.table(_restated_table(spark, sf_dir)).select("row_key", *keyed.family_fields())


def keyed_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order of that table, by SQL: only its bucket is opened."""
    name = _restated_table(spark, sf_dir)
    key = star.table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0]
    found = spark.sql(f"SELECT * FROM {name}_of('{key}')")
    return found.select("row_key", *keyed.family_fields())


def keyed_source_sink_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed table from the sink that commits batches."""
    rows = keyed_source.committed_rows(spark, staging.keyed_source(spark, sf_dir))
    table = sinks.latest_orders(rows, order_by=list(FIELD_NAMES))
    return table.select("row_key", *keyed.family_fields())


def lines_per_order_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the number and quantity of their lines, joined where both tables lie."""
    orders, lines = (spark.table(name) for name in staging.bucketed_orders(spark, sf_dir))
    counted = lines.groupBy("row_key").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("procured_quantity").alias("quantity"))
    return orders.hint("merge").join(counted, "row_key").select(
        "row_key", F.col("metadata.city_name").alias("city_name"), "lines", "quantity")


def land_variant_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed variants read by path."""
    documents = spark.read.parquet(staging.landed_variants(spark, sf_dir))
    return _plain(parse.variant_lines(documents, EXACT_MONEY))


def order_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line in the layout of the keyed table, shown as family_field columns."""
    table = keyed.to_families(star.order_lines(spark, sf_dir))
    return _plain(table.select("row_key", *[
        F.col(f"{family}.{name}").alias(f"{family}_{name}")
        for name, family in keyed.FAMILY_OF.items()
    ]))


def land_raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(staging.landed_orders(spark, sf_dir))
    return _plain(documents.select("raw", *FIELD_NAMES, "timestamp"))


# Read side -----------------------------------------------------------------------------

def _results(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The log of the one-query job; the nine streams write the same one at a higher price."""
    messages = staging.one_pass_results(spark, sf_dir).replay(spark)
    return readside.result_rows(messages, fields)


def _of_metric(
    spark: SparkSession, sf_dir: str, metric: str, mode: str, *fields: str
) -> DataFrame:
    """Rows of one metric from that log; for the latest ones only their folder is opened."""
    newest = newest_snapshots(staging.one_pass_results(spark, sf_dir), spark)
    return readside.of_metric(_results(spark, sf_dir, *fields), metric, mode, newest)


def _told(rows: DataFrame) -> DataFrame:
    """Without what differs from run to run."""
    return _plain(rows.drop("error", "run_id", "published_at", "message_id"))


def replay_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_results(spark, sf_dir))


def replay_unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with fields that no job sends, found by looking at the messages."""
    rows = readside.all_result_rows(staging.mixed_topic(spark, sf_dir).replay(spark))
    return rows.where("metric IS NOT NULL").select(
        "metric", "event_id", "customer", F.col("details.amount").cast("double").alias("amount"))


def replay_repeated_unknown_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a metric that no job knows, sent twice, each read once. Their fields are named
    like columns of the topic."""
    rows = _foreign(spark, sf_dir).where("metric IS NOT NULL")
    return rows.select("metric", "event_id", "value", "topic",
                       F.col("partition").cast("long").alias("partition"),
                       F.col("offset").cast("long").alias("offset"), "key")


def replay_repeated_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _foreign(spark, sf_dir).where(readside.is_error()).select("error")


def _foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = staging.foreign_results(spark, sf_dir).replay(spark)
    return readside.all_result_rows(readside.unrepeated(messages))


def malformed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = parse.malformed_messages(staging.mixed_topic(spark, sf_dir).replay(spark))
    return messages.select("malformed")


def non_numeric_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per number field, how many values of all messages are set but no number."""
    wire = parse.wire_lines(staging.mixed_topic(spark, sf_dir).replay(spark))
    unread = parse.unread_numbers(FIELD_NAMES, EXACT_MONEY)
    counts = wire.agg(*[F.count_if(bad).alias(name) for name, bad in unread.items()])
    return counts.unpivot([], list(unread), "field", "non_numeric").where("non_numeric > 0")


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages read, kept and rejected by reason, from the job that splits them."""
    judged = spark.read.parquet(staging.checked_messages(spark, sf_dir))
    return rejects.reason_counts(judged)


def incomplete_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without a value in the raw sales, by column."""
    rows = read_csv(spark, staging.raw_sales(spark, sf_dir))
    needed = [name for name in rows.columns if not name.startswith("Unnamed")]
    return rejects.reason_counts(rejects.judge_cells(rows, needed))


def aov_histogram_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of the customers' mean order values over all snapshots, from merged sketches, next to
    whether each is as close to the exact count as sketches promise."""
    merged = sketches.merge(spark.read.parquet(staging.aov_sketches(spark, sf_dir)))
    close = sketches.histogram(merged).withColumnRenamed("customers", "about")
    rows = _of_metric(spark, sf_dir, "aov_by_customer", "cumulative", "average_order_value")
    exact = readside.histogram(rows, "average_order_value")
    bound = 2 * sketches.RANK_ERROR * merged.select(F.sum("n")).scalar() + 1
    both = exact.join(close.select("bin", "about"), "bin", "left")
    return both.select(
        "bin", "customers", *[F.round(name, 6).alias(name) for name in ("bin_start", "bin_end")],
        (F.abs(F.coalesce("about", F.lit(0)) - F.col("customers")) <= bound).alias("close"))


def publish_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a CSV file as messages; blank cells are empty texts."""
    rows = read_csv(spark, staging.raw_products(spark, sf_dir))
    rows = rows.select(*[name for name in rows.columns if not name.startswith("Unnamed")])
    return rows.select(order_payload(rows, blank="").alias("value"))


def dash_brands_without_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that name a brand but carry no count: each counts as one."""
    rows = _results(spark, sf_dir, "brand_name", "brand_count").where(
        "metric = 'discount_by_brand'")
    return readside.total_per_key(rows, "brand_name", "brand_count")


def replay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readside.messages_per_metric(_results(spark, sf_dir, "metric"))


def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readside.metric_names(_results(spark, sf_dir, "metric"))


def export_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replayed results as CSV, read back."""
    rows = readside.flat_results(_results(spark, sf_dir).drop(
        "error", "run_id", "published_at", "message_id"))
    path = staging.exported_results(spark, sf_dir, rows)
    return _plain(read_csv(spark, path).select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema
    ]))


def _dash_total(metric: str, key: str, measure: str, ranked: bool, mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _of_metric(spark, sf_dir, metric, mode, key, measure)
        totals = readside.total_per_key(rows, key, measure)
        return readside.top(totals, key, measure) if ranked else totals

    return query


def dash_product_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _results(spark, sf_dir, "product_name")
    rows = readside.of_metric(results, "top_products", "cumulative")
    counts = readside.message_counts(rows, "product_name")
    return readside.top(counts, "product_name", "count")


def _dash_aov(mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        key, measure = "dim_customer_key", "average_order_value"
        rows = _of_metric(spark, sf_dir, "aov_by_customer", mode, key, measure)
        return readside.mean_per_key(rows, key, measure)

    return query


def _dash_quantity_by_city(mode: str) -> Query:
    totals = _dash_total(
        "quantity_by_city", "city_name", "total_procured_quantity", False, mode)
    return lambda spark, sf_dir: totals(spark, sf_dir).orderBy(
        F.desc("total_procured_quantity"), "city_name")


def aov_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = readside.histogram(_dash_aov("latest")(spark, sf_dir), "average_order_value")
    return bins.withColumns({name: F.round(name, 6) for name in ("bin_start", "bin_end")})


def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _dash_total("sales_by_category", "l1_category", "total_sales", False, "latest")
    shares = readside.share_of_total(totals(spark, sf_dir), "total_sales")
    return shares.withColumn("share", F.round("share", 9))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages, their type as metric; those without a metric do not count."""
    return star.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("metric"), "event_id", "user_id", "value",
    ).where(readside.has_metric())


def last_100_per_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent.last_per_key(_messages(spark, sf_dir), "metric", ["event_id"])


def last_100_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent.last_overall(_messages(spark, sf_dir), ["event_id"])


# Streams, read back from their sinks ---------------------------------------------------

def _snapshot_query(name: str, results: Callable[[SparkSession, str], FolderTopic]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        outputs = metrics.METRICS[name].outputs
        topic = results(spark, sf_dir)
        rows = readside.result_rows(topic.replay(spark), outputs)
        newest = readside.of_metric(rows, name, "latest", newest_snapshots(topic, spark))
        return _plain(newest.select(*outputs))

    return query


def metric_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All snapshots of the nine streams."""
    return _told(readside.result_rows(staging.metric_results(spark, sf_dir).replay(spark)))


def one_pass_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshot of every metric of the one-query job."""
    return _newest_snapshots(spark, staging.one_pass_results(spark, sf_dir))


def _newest_snapshots(spark: SparkSession, topic: FolderTopic) -> DataFrame:
    rows = readside.result_rows(topic.replay(spark))
    newest = readside.newest_of_all(rows, newest_snapshots(topic, spark))
    return _told(newest.drop("epoch_id"))


def metric_log_new_checkpoint_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshots after a job was started anew: those of the later run."""
    return _newest_snapshots(spark, staging.results_after_new_checkpoint(spark, sf_dir))


def result_feed_repeated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot that was sent twice, read once."""
    messages = staging.repeated_results(spark, sf_dir).replay(spark)
    return _told(readside.without_repeats(messages).drop("epoch_id"))


def totals_during_rerun_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics from changed totals, while a new run is still catching up."""
    return _picked(sinks.current_totals(spark, staging.totals_during_rerun(spark, sf_dir)))


def compacted_totals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics from totals that were compacted and then went on."""
    return _picked(sinks.current_totals(spark, staging.compacted_totals(spark, sf_dir)))


def _picked(totals: DataFrame) -> DataFrame:
    return _plain(metrics.union_of([
        metrics.labelled(metric, metrics.pick(totals, metric)) for metric in metrics.ALL]))


def result_feed_deduplicated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed of a log that holds its last snapshot twice."""
    rows = spark.read.parquet(f"{staging.repeated_feed(spark, sf_dir)}/feed")
    return _told(rows.drop("epoch_id", "message_run_id", "batch_id", "stored_at", "position"))


def recent_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last messages per metric, kept as state of a stream over repeated messages."""
    rows = recent_state.stored_last_messages(
        spark, staging.recent_lists(spark, sf_dir), staging.FEED_SCHEMA)
    return rows.select("metric", "event_id", "user_id", "value")


def throttled_feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a throttled topic, and whether each batch kept to the limit."""
    path, limit = staging.throttled_batches(spark, sf_dir)
    rows = spark.read.parquet(f"{path}/feed").select("batch_id")
    rows = rows.union(spark.read.parquet(f"{path}/errors").select("batch_id"))
    sizes = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("messages"))
    return sizes.agg(F.sum("messages").alias("messages"),
                     (F.max("messages") <= limit).alias("within_limit"))


def _best_query(name: str) -> Query:
    """A top list that was kept up incrementally."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = staging.best_lists(spark, sf_dir, name)
        return _plain(sinks.current_best(spark, path, metrics.METRICS[name]))

    return query


def sales_trend_corrected_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend of lines half of which were late, with corrections."""
    path = staging.trend_with_late_lines(spark, sf_dir)
    return _plain(sinks.stored_trend(spark, path, metrics.METRICS["sales_trend"]))


def _changes_query(name: str) -> Query:
    """A metric from the totals that each batch changed."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        totals = sinks.current_totals(spark, staging.changed_totals(spark, sf_dir))
        return _plain(metrics.pick(totals, metrics.METRICS[name]))

    return query


def sales_trend_bounded_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.read.parquet(staging.bounded_trend(spark, sf_dir))
    newest = keyed.latest_per_key(changes, ["window", "l1_category"], ["batch_id"])
    return _plain(newest.drop("batch_id", "run_id", "stored_at"))


def result_feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{staging.feed(spark, sf_dir)}/feed")
    return rows.select("metric", "event_id", "user_id", "value")


def result_feed_errors_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{staging.feed(spark, sf_dir)}/errors")
    return rows.select("error", "event_id", "user_id", "value")


def recent_messages_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.recent_rows(spark, f"{staging.feed(spark, sf_dir)}/recent")
    return rows.select("metric", "event_id", "user_id", "value")


def all_queries() -> dict[str, Query]:
    registered: dict[str, Query] = {
        name: _metric_query(name) for name in metrics.METRICS if name != "sales_trend"
    }
    registered |= {
        "sales_trend": sales_trend,
        "sales_trend_orders": _metric_query("sales_trend"),
        "multi_metric_one_pass": multi_metric_one_pass,
        "metric_log": metric_log,
        "prep_sales": prep_sales,
        "publish_orders": publish_orders,
        "parse_orders": parse_orders,
        "parse_orders_strict": parse_orders_strict,
        "upsert_orders": upsert_orders,
        "order_families": order_families,
        "land_raw_orders": land_raw_orders,
        "replay_results": replay_results,
        "replay_counts": replay_counts,
        "metric_names": metric_names,
        "export_results": export_results,
        "dash_product_frequency": dash_product_frequency,
        "aov_histogram": aov_histogram,
        "category_share": category_share,
        "last_100_per_metric": last_100_per_metric,
        "last_100_messages": last_100_messages,
        "metric_streams": metric_streams,
        "one_pass_stream": one_pass_stream,
        "upsert_orders_stream": upsert_orders_stream,
        "sales_trend_bounded_stream": sales_trend_bounded_stream,
        "result_feed_stream": result_feed_stream,
        "result_feed_errors_stream": result_feed_errors_stream,
        "recent_messages_stream": recent_messages_stream,
        "one_pass_discount_only": one_pass_discount_only,
        "one_pass_two_counts": one_pass_two_counts,
        "upsert_orders_new_checkpoint_stream": upsert_orders_new_checkpoint_stream,
        "metric_log_new_checkpoint_stream": metric_log_new_checkpoint_stream,
        "result_feed_repeated_stream": result_feed_repeated_stream,
        "compacted_orders": compacted_orders,
        "order_lookup": order_lookup,
        "keyed_table_view": keyed_table_view,
        "replay_unknown_fields": replay_unknown_fields,
        "malformed_orders": malformed_orders,
        "non_numeric_measures": non_numeric_measures,
        "publish_csv_rows": publish_csv_rows,
        "dash_brands_without_measure": dash_brands_without_measure,
        "replay_repeated_unknown_metrics": replay_repeated_unknown_metrics,
        "replay_repeated_errors": replay_repeated_errors,
        "prep_sales_stream": prep_sales_stream,
        "top_brands_best_stream": _best_query("top_brands"),
        "top_products_best_stream": _best_query("top_products"),
        "sales_trend_corrected_stream": sales_trend_corrected_stream,
        "reject_reasons": reject_reasons,
        "incomplete_sales": incomplete_sales,
        "aov_histogram_sketch": aov_histogram_sketch,
        "result_feed_deduplicated_stream": result_feed_deduplicated_stream,
        "recent_state_stream": recent_state_stream,
        "keyed_source_sink_stream": keyed_source_sink_stream,
        "throttled_feed_stream": throttled_feed_stream,
        "land_variant_orders": land_variant_orders,
        "totals_during_rerun_stream": totals_during_rerun_stream,
        "compacted_totals_stream": compacted_totals_stream,
        "lines_per_order_bucketed": lines_per_order_bucketed,
        "keyed_table_restated": keyed_table_restated,
        "keyed_table_lookup": keyed_table_lookup,
    }
    for suffix, mode in MODES.items():
        registered |= {
            f"dash_top_products{suffix}": _dash_total(
                "top_products", "product_name", "total_quantity_sold", True, mode),
            f"dash_top_brands{suffix}": _dash_total(
                "top_brands", "brand_name", "brand_count", True, mode),
            f"dash_sales_by_category{suffix}": _dash_total(
                "sales_by_category", "l1_category", "total_sales", False, mode),
            f"dash_quantity_by_city{suffix}": _dash_quantity_by_city(mode),
            f"dash_aov{suffix}": _dash_aov(mode),
        }
    registered |= {
        f"{name}_stream": _snapshot_query(name, staging.metric_results)
        for name in metrics.METRICS
    }
    registered |= {f"{name}_changes_stream": _changes_query(name) for name in metrics.METRICS}
    return registered
