"""What the planner makes of the operators: the shape that has to hold at scale."""

import pytest

from tillstream.operators import keyed, metrics, readside, recent
from tillstream.operators.parse import parse_orders
from tillstream.operators.prepare import prepare
from tillstream.sources import star
from tillstream.sources.topics import FolderTopic, result_folder
from tillstream.streaming.sinks import publish_metrics

SF = "/root/testdata/sf0.001"


def plan(table):
    return table._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(metrics.METRICS))
def test_metrics_aggregate_before_the_shuffle(lines, name):
    text = plan(metrics.METRICS[name].compute(lines({"l1_category": "a"})))
    assert "partial_" in text
    assert text.count("Exchange hashpartitioning") == 1
    if metrics.METRICS[name].top_by:
        assert "TakeOrderedAndProject" in text


def test_one_pass_shuffles_once(lines):
    text = plan(metrics.compute_all(lines({"l1_category": "a"})))
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_only_needed_columns_and_lookups_are_read(spark):
    metric = metrics.METRICS["sales_by_category"]
    text = plan(metric.compute(star.order_lines(spark, SF, *metric.fields)))
    assert "struct<l_partkey:bigint,l_extendedprice:double>" in text
    assert "struct<p_partkey:bigint,p_type:string>" in text
    assert text.count("Join") == 1
    metric = metrics.METRICS["aov_by_customer"]
    text = plan(metric.compute(star.order_lines(spark, SF, *metric.fields)))
    assert "struct<o_orderkey:bigint,o_custkey:bigint>" in text and text.count("Join") == 1


def test_large_lookups_are_not_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert "Broadcast" not in plan(star.order_lines(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_join_partitions_are_split(spark):
    """A third of the sales are of one product; the lookup is too large to broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        sales = spark.range(60000).selectExpr(
            "CAST(if(id % 3 = 0, 7, id % 3000) AS STRING) AS product_id",
            "CAST(id AS STRING) AS order_id", "'Pune' AS city_name")
        products = spark.range(3000).selectExpr(
            "CAST(id AS STRING) AS product_id", "concat('name ', id) AS product_name")
        table = prepare(sales.repartition(8), products)
        assert len(table.collect()) == 60000
        assert "SortMergeJoin(skew=true)" in plan(table)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def test_parsing_reads_only_the_asked_fields(messages):
    metric = metrics.METRICS["aov_by_customer"]
    text = plan(metric.compute(parse_orders(messages({"x": 1}), fields=metric.fields)))
    assert "StructField(order_id" in text and "StructField(unit," not in text
    assert "Python" not in text


def test_latest_per_key_keeps_one_row_per_task_and_key(lines):
    table = lines({"order_id": 1})
    text = plan(keyed.latest_per_key(table, ["order_id"], ["procured_quantity"]))
    assert "partial_max" in text and text.count("Exchange") == 1 and "Window" not in text


def test_last_messages_are_cut_before_the_shuffle(spark):
    table = spark.range(1000).selectExpr("id % 2 AS metric", "id AS n")
    text = plan(recent.last_per_key(table, "metric", ["n"]))
    below = text[text.index("Exchange"):]
    assert "WindowGroupLimit" in below and "Partial" in below
    assert "TakeOrderedAndProject" in plan(recent.last_overall(table, ["n"]))


def test_latest_snapshot_opens_only_its_folder(spark, tmp_path):
    log = result_folder(str(tmp_path / "log"))
    cities = spark.createDataFrame([("x", 1)], "city_name string, total_orders long")
    categories = spark.createDataFrame([("a", 1.0)], "l1_category string, total_sales double")
    for epoch in range(3):
        publish_metrics(log, {"orders_by_city": cities, "sales_by_category": categories}, epoch)
    newest = readside.of_metric(
        readside.result_rows(log.replay(spark), ["total_orders"]), "orders_by_city")
    assert [row.total_orders for row in newest.collect()] == [1]
    scans = [line for line in plan(newest).splitlines() if "FileScan" in line]
    filters = [line.split("PartitionFilters: ")[1] for line in scans]
    assert all("metric" in text for text in filters)
    assert any("isnotnull(epoch_id" in text for text in filters)
    assert all("DataFilters: []" in line for line in scans)


def test_shares_and_bins_need_no_single_task_window(spark):
    table = spark.range(10).selectExpr("id AS k", "CAST(id AS DOUBLE) AS v")
    for result in (readside.share_of_total(table, "v"), readside.histogram(table, "v")):
        text = plan(result)
        assert "Window" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_publishing_does_not_shuffle(spark, tmp_path):
    rows = spark.range(10).selectExpr("CAST(id AS STRING) AS value")
    assert "Exchange" not in plan(FolderTopic(str(tmp_path), "t")._messages(rows))
