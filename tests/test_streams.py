from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.operators import keyed, readside
from tillstream.operators.metrics import METRICS, pick
from tillstream.operators.parse import parse_orders
from tillstream.schema import EXACT_MONEY
from tillstream.sources.topics import FolderTopic, newest_snapshots, result_folder
from tillstream.streaming import jobs, sinks

FIRST = [
    {"order_id": "1", "l1_category": "a", "city_name": "x", "brand_name": "p",
     "product_name": "u", "dim_customer_key": "1", "procured_quantity": "2",
     "unit_selling_price": "1.10", "total_discount_amount": "0.5",
     "date_": "2022-04-01 10:00:00"},
    {"order_id": "2", "l1_category": None, "city_name": "y", "brand_name": None,
     "product_name": "v", "dim_customer_key": "2", "procured_quantity": "1",
     "unit_selling_price": "2.20", "total_discount_amount": "0", "date_": "2022-04-01"},
    "not json",
]
SECOND = [
    {"order_id": "3", "l1_category": "a", "city_name": "x", "brand_name": "q",
     "product_name": "v", "dim_customer_key": "1", "procured_quantity": "7",
     "unit_selling_price": "3.30", "total_discount_amount": "0.25",
     "date_": "2022-04-01 09:00:00"},
]


@pytest.mark.parametrize("start", [jobs.start_metrics, jobs.start_metrics_one_pass])
def test_snapshots_equal_the_metrics_over_the_table(spark, topic, tmp_path, rows, start):
    orders, send = topic
    results = result_folder(str(tmp_path / "results"))

    def run():
        jobs.finish(start(spark, orders, results, jobs.Run(
            str(tmp_path / "cp"), jobs.DRAIN, money=EXACT_MONEY)))

    send(*FIRST)
    run()
    send(*SECOND)
    run()
    run()  # nothing new: no further epoch
    log = readside.result_rows(results.replay(spark))
    assert rows(log.select("epoch_id").distinct()) == [(0,), (1,)]
    assert rows(readside.metric_names(log)) == sorted((name,) for name in METRICS)
    table = parse_orders(orders.replay(spark), EXACT_MONEY)
    for name, metric in METRICS.items():
        newest = readside.of_metric(log, name).select(*metric.outputs)
        assert rows(newest) == rows(metric.compute(table)), name


def test_files_per_batch_can_be_limited(spark, topic, tmp_path):
    orders, send = topic
    results = result_folder(str(tmp_path / "results"))
    for message in FIRST:
        send(message)
    jobs.finish(jobs.start_metrics(
        spark, orders, results, jobs.Run(str(tmp_path / "cp"), jobs.DRAIN, limit=1),
        ["orders_by_city"]))
    assert results.replay(spark).select("epoch_id").distinct().count() == 3


def test_empty_snapshot_is_not_published(spark, topic, tmp_path, rows):
    orders, send = topic
    results = result_folder(str(tmp_path / "results"))

    def run():
        jobs.finish(jobs.start_metrics(
            spark, orders, results, jobs.Run(str(tmp_path / "cp"), jobs.DRAIN),
            ["orders_by_city"]))

    send()
    run()
    assert not (tmp_path / "results").exists()
    send(*FIRST)
    run()
    assert rows(results.replay(spark).select("epoch_id").distinct()) == [(1,)]


def test_partitions_are_those_of_the_job(spark, topic, tmp_path):
    orders, send = topic
    results = result_folder(str(tmp_path / "results"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    send(*FIRST)
    (query,) = jobs.start_metrics(
        spark, orders, results, jobs.Run(str(tmp_path / "cp"), jobs.DRAIN, partitions=2),
        ["aov_by_customer"])
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    jobs.finish([query])
    assert query.lastProgress.stateOperators[0].numShufflePartitions == 2


def test_live_job_takes_new_messages(spark, topic, tmp_path, rows):
    orders, send = topic
    results = result_folder(str(tmp_path / "results"))
    send(*FIRST)
    (query,) = jobs.start_metrics(
        spark, orders, results,
        jobs.Run(str(tmp_path / "cp"), {"processingTime": "100 milliseconds"}),
        ["orders_by_city"])
    try:
        query.processAllAvailable()
        send(*SECOND)
        query.processAllAvailable()
    finally:
        query.stop()
    log = readside.result_rows(results.replay(spark))
    newest = readside.of_metric(log, "orders_by_city")
    assert rows(newest.select("city_name", "total_orders")) == [("x", 2), ("y", 1), (None, 0)]


def test_prices_are_doubles_unless_asked_otherwise(spark, topic, tmp_path, rows):
    orders, send = topic
    results = result_folder(str(tmp_path / "results"))
    send({"l1_category": "a", "unit_selling_price": "0.123456789"})
    jobs.finish(jobs.start_metrics(
        spark, orders, results, jobs.Run(str(tmp_path / "cp"), jobs.DRAIN),
        ["sales_by_category"]))
    log = readside.result_rows(results.replay(spark))
    assert rows(log.select("total_sales")) == [(0.123456789,)]


def price(time, amount):
    return {"l1_category": "a", "date_": time, "unit_selling_price": amount}


def test_bounded_trend_drops_late_lines_and_the_plain_one_does_not(spark, topic, tmp_path, rows):
    orders, send = topic
    trend, results = str(tmp_path / "trend"), result_folder(str(tmp_path / "results"))

    def run():
        jobs.finish([
            jobs.start_bounded_trend(
                spark, orders, trend, jobs.Run(str(tmp_path / "cp"), jobs.DRAIN), "1 hour"),
            *jobs.start_metrics(
                spark, orders, results, jobs.Run(str(tmp_path / "cp2"), jobs.DRAIN),
                ["sales_trend"]),
        ])

    send(price("2022-04-01 10:00:00", "1"), price("2022-04-01 12:00:00", "2"))
    run()
    send(price("2022-04-01 10:05:00", "4"),  # later than an hour
         price("2022-04-01 11:55:00", "8"), price("2022-04-01 12:01:00", "16"))
    run()
    changes = spark.read.parquet(trend)
    newest = keyed.latest_per_key(changes, ["window", "l1_category"], ["batch_id"])
    bounded = rows(newest.select("window.start", "sales"))
    at = lambda hour, minute: datetime(2022, 4, 1, hour, minute)
    assert bounded == [(at(10, 0), 1.0), (at(11, 50), 8.0), (at(12, 0), 18.0)]
    log = readside.of_metric(readside.result_rows(results.replay(spark)), "sales_trend")
    assert rows(log.select("window.start", "sales")) == [
        (at(10, 0), 5.0), (at(11, 50), 8.0), (at(12, 0), 18.0)]


def test_landing_keeps_every_message_once(spark, topic, tmp_path, rows):
    orders, send = topic
    path = str(tmp_path / "documents")

    def run():
        jobs.finish([jobs.start_landing(
            spark, orders, path, jobs.Run(str(tmp_path / "cp"), jobs.DRAIN))])

    send(*FIRST)
    run()
    send(*SECOND)
    run()
    run()
    documents = spark.read.parquet(path)
    sent = orders.replay(spark).select(F.col("value").cast("string"))
    assert rows(documents.select("raw")) == rows(sent)
    assert documents.where("source.topic = 'ecommerce' AND ingested_at IS NOT NULL").count() == 4
    assert documents.where("order_id = 3 AND procured_quantity = 7").count() == 1


def test_feed(spark, tmp_path, rows):
    results = FolderTopic(str(tmp_path / "topic"), "eda_results")
    schema = T.StructType([T.StructField("metric", T.StringType()),
                           T.StructField("error", T.StringType()),
                           T.StructField("n", T.IntegerType())])

    def send(*texts):
        results.append(spark.createDataFrame([(t,) for t in texts], "value string"))
        jobs.finish([jobs.start_feed(spark, results, str(tmp_path / "feed"),
                                     jobs.Run(str(tmp_path / "cp"), jobs.DRAIN), schema)])

    send('{"metric":"a","n":1}', '{"n":2}', '{"metric":"","n":3}', '{"error":"down"}')
    send(*[f'{{"metric":"a","n":{n}}}' for n in range(10, 130)], '{"metric":"b","n":1}')
    feed = spark.read.parquet(str(tmp_path / "feed/feed"))
    assert feed.groupBy("metric").count().orderBy("metric").collect() == [("a", 121), ("b", 1)]
    assert rows(spark.read.parquet(str(tmp_path / "feed/errors")).select("error")) == [("down",)]
    kept = sinks.recent_rows(spark, str(tmp_path / "feed/recent"))
    assert kept.where("metric = 'a'").count() == 100
    assert kept.where("metric = 'b'").count() == 1
    # Arrival order within a publish follows the task and the row, so all are of the second.
    assert kept.where("metric = 'a' AND n = 1").count() == 0


def test_recent_messages_go_on_after_a_new_checkpoint(spark, tmp_path, rows):
    results = FolderTopic(str(tmp_path / "topic"), "eda_results")
    schema = T.StructType([T.StructField("metric", T.StringType()),
                           T.StructField("error", T.StringType()),
                           T.StructField("n", T.IntegerType())])
    path = str(tmp_path / "feed")
    for n, checkpoint in enumerate(("a", "a", "a", "b")):
        results.append(spark.createDataFrame([(f'{{"metric":"m","n":{n}}}',)], "value string"))
        jobs.finish([jobs.start_feed(
            spark, results, path, jobs.Run(str(tmp_path / checkpoint), jobs.DRAIN), schema)])
    last = sinks.recent_rows(spark, f"{path}/recent")
    assert {n for _, n in rows(last.select("metric", "n"))} == {0, 1, 2, 3}
    assert len(sinks.recent_versions(spark, f"{path}/recent")) == 2
    assert spark.read.parquet(f"{path}/feed").select("run_id").distinct().count() == 2


@pytest.mark.parametrize("start", [jobs.start_metrics, jobs.start_metrics_one_pass])
def test_new_checkpoint_adds_a_run_to_the_log(spark, topic, tmp_path, rows, start):
    orders, send = topic
    results = result_folder(str(tmp_path / "results"))
    for n, messages in enumerate((FIRST, SECOND)):
        send(*messages)
        jobs.finish(start(spark, orders, results, jobs.Run(
            str(tmp_path / f"cp{n}"), jobs.DRAIN, money=EXACT_MONEY)))
    newest = newest_snapshots(results, spark)
    table = parse_orders(orders.replay(spark), EXACT_MONEY)
    log = readside.result_rows(results.replay(spark))
    assert log.select("run_id", "epoch_id").distinct().count() == (
        18 if start is jobs.start_metrics else 2)
    for name, metric in METRICS.items():
        for told in (newest, None):
            found = readside.of_metric(log, name, newest=told).select(*metric.outputs)
            assert rows(found) == rows(metric.compute(table)), name


def test_changed_totals_hold_the_changed_keys_only(spark, topic, tmp_path, rows):
    orders, send = topic
    path = str(tmp_path / "changes")

    def run():
        jobs.finish([jobs.start_metric_changes(spark, orders, path, jobs.Run(
            str(tmp_path / "cp"), jobs.DRAIN, money=EXACT_MONEY))])

    send(*FIRST)
    run()
    send(*SECOND)
    run()
    second = spark.read.parquet(path).where("batch_id = 1")
    assert rows(second.where("key_set = 'city_name'").select("key")) == [("x",)]
    assert rows(second.where("key_set = 'dim_customer_key'").select("key")) == [("1",)]
    table = parse_orders(orders.replay(spark), EXACT_MONEY)
    totals = sinks.current_totals(spark, path)
    for name, metric in METRICS.items():
        assert rows(pick(totals, metric)) == rows(metric.compute(table)), name


def test_progress_reports_count_what_could_not_be_read(spark, topic, tmp_path):
    orders, send = topic
    send("not json", {"order_id": "x1", "city_name": "a"}, {"order_id": "2", "city_name": "a"})
    (query,) = jobs.start_metrics(
        spark, orders, result_folder(str(tmp_path / "results")),
        jobs.Run(str(tmp_path / "cp"), jobs.DRAIN), ["orders_by_city"])
    jobs.finish([query])
    counts = [p.observedMetrics["order_input"] for p in query.recentProgress
              if "order_input" in p.observedMetrics]
    assert sum(c.lines for c in counts) == 3
    assert sum(c.malformed for c in counts) == 1
    assert sum(c.unread_order_id for c in counts) == 1


def test_live_job_ends_with_its_first_query(spark, topic, tmp_path):
    orders, send = topic
    send(*FIRST)
    live = jobs.Run(str(tmp_path / "cp"), {"processingTime": "100 milliseconds"})
    queries = jobs.start_metrics(spark, orders, result_folder(str(tmp_path / "results")), live,
                                 ["orders_by_city", "top_brands"])
    queries[1].stop()
    jobs.run_until_any_ends(spark, queries)
    assert not any(query.isActive for query in queries)
