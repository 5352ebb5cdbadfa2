import pytest
from pyspark.sql import functions as F

from tillstream.operators import readside, recent
from tillstream.sources.topics import FolderTopic, newest_snapshots, result_folder
from tillstream.streaming.sinks import publish_metrics


@pytest.fixture
def results(spark, messages):
    return lambda *values: readside.result_rows(messages(*values))


def brand(name, count, epoch):
    return {"metric": "top_brands", "brand_name": name, "brand_count": count, "epoch_id": epoch}


def test_latest_and_cumulative(results, rows):
    log = results(brand("a", 1, 0), brand("a", 3, 1), brand("b", 2, 1), brand("c", 9, 0))
    total = lambda mode: rows(readside.total_per_key(
        readside.of_metric(log, "top_brands", mode), "brand_name", "brand_count"))
    assert total("latest") == [("a", 3), ("b", 2)]
    assert total("cumulative") == [("a", 4), ("b", 2), ("c", 9)]
    with pytest.raises(ValueError):
        readside.of_metric(log, "top_brands", "newest")


def test_newest_epoch_of_every_metric(results, rows):
    log = results(brand("a", 1, 0), brand("a", 3, 1), {"metric": "other", "epoch_id": 0})
    assert rows(readside.newest_of_all(log).select("metric", "epoch_id")) == [
        ("other", 0), ("top_brands", 1)]


def test_metric_names_are_normalised(results, rows):
    log = results({"metric": "Top Brands"}, {"metric": "top_brands"}, {"x": 1})
    assert rows(readside.metric_names(log)) == [("top_brands",), (None,)]
    assert rows(readside.messages_per_metric(log)) == [
        ("top_brands", 0, 2), (None, 0, 1), (None, 1, 3)]


def test_rows_without_key_are_left_out_and_empty_sums_are_zero(results, rows):
    log = results(brand(None, 5, 0), brand("a", None, 0))  # some message carries the measure
    assert rows(readside.total_per_key(log, "brand_name", "brand_count")) == [("a", 0)]


def test_missing_measure_counts_messages(results, rows):
    log = results(brand("a", 7, 0), brand("a", 7, 1), brand("b", 7, 1)).drop("brand_count")
    assert rows(readside.total_per_key(log, "brand_name", "brand_count")) == [("a", 2), ("b", 1)]


def test_measure_that_no_message_carries_counts_messages(results, rows):
    log = results(*[{"metric": "top_brands", "brand_name": "a"}] * 3)
    assert rows(readside.total_per_key(log, "brand_name", "brand_count")) == [("a", 3)]


def test_every_field_of_the_messages_is_kept(messages, rows):
    log = readside.all_result_rows(messages(
        {"metric": "new", "x": 1, "deep": {"y": "z"}}, {"metric": "new", "x": 2.5, "none": None},
        "not json", {"metric": "top_brands", "brand_count": 3}))
    assert {"x", "deep", "brand_count"} <= set(log.columns)
    assert rows(log.where("metric = 'new'").selectExpr("cast(x as double)", "deep.y")) == [
        (1.0, "z"), (2.5, None)]
    assert rows(log.where("metric = 'top_brands'").select("brand_count")) == [(3,)]
    assert rows(readside.all_result_rows(messages("not json")).select("metric")) == [(None,)]


def test_newest_is_the_snapshot_published_last(results, rows):
    def snapshot(run, epoch, at, total):
        return {"metric": "m", "run_id": run, "epoch_id": epoch, "total_sales": total,
                "published_at": f"2024-01-01T00:00:{at:02d}.000Z"}

    log = results(*[snapshot("old", e, e, float(e)) for e in range(6)], snapshot("new", 0, 30, 999.0))
    assert rows(readside.of_metric(log, "m").select("total_sales")) == [(999.0,)]
    assert rows(readside.newest_of_all(log).select("total_sales")) == [(999.0,)]


def test_messages_of_a_batch_that_ran_twice_count_once(spark, tmp_path, rows):
    log = FolderTopic(str(tmp_path / "log"), "eda_results")
    message = spark.createDataFrame(
        [('{"metric":"sales_by_category","run_id":"r","epoch_id":0,"l1_category":"a",'
          '"total_sales":5.0}',)], "value string")
    for _ in range(2):
        log.append(message)
    found = readside.without_repeats(log.replay(spark), ["l1_category", "total_sales"])
    assert rows(readside.total_per_key(found, "l1_category", "total_sales")) == [("a", 5.0)]


def test_missing_key_column_is_refused(results):
    with pytest.raises(ValueError, match="brand_name"):
        readside.total_per_key(results(brand("a", 7, 0)).drop("brand_name"), "brand_name", "x")


def test_text_measures(spark, rows):
    table = spark.createDataFrame([("a", "1.5"), ("a", "x"), ("b", None)], "k string, m string")
    assert rows(readside.total_per_key(table, "k", "m")) == [("a", 1.5), ("b", 0.0)]
    assert rows(readside.non_numeric(table, "m")) == [(1,)]


def test_top_breaks_ties_by_name(spark):
    table = spark.createDataFrame([(f"n{i:02d}", 1) for i in range(12)], "k string, m int")
    assert [r.k for r in readside.top(table, "k", "m").collect()] == [
        f"n{i:02d}" for i in range(10)]


def test_message_frequency(results, rows):
    log = results(*[{"metric": "top_products", "product_name": p} for p in ("a", "b", "a", None)])
    assert rows(readside.message_counts(log, "product_name")) == [("a", 2), ("b", 1)]


def test_mean_over_snapshots(results, rows):
    log = results(*[{"metric": "aov_by_customer", "dim_customer_key": 1,
                     "average_order_value": v, "epoch_id": e} for e, v in enumerate((1.0, 4.0))])
    assert rows(readside.mean_per_key(log, "dim_customer_key", "average_order_value")) == [
        (1, 2.5)]


def test_share(spark, rows):
    table = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    assert rows(readside.share_of_total(table, "v")) == [("a", 1.0, 0.25), ("b", 3.0, 0.75)]
    zero = readside.share_of_total(table.withColumn("v", F.lit(0.0)), "v")
    assert [r.share for r in zero.collect()] == [None, None]


def test_histogram(spark, rows):
    table = spark.createDataFrame([(float(v),) for v in range(0, 41)] + [(None,)], "v double")
    bins = rows(readside.histogram(table, "v"))
    assert sum(b[1] for b in bins) == 41
    assert sorted(b[0] for b in bins) == list(range(1, 21))
    assert {b[0]: b[1] for b in bins}[20] == 3  # the largest value joins the last bin
    same = readside.histogram(table.where("v = 3"), "v")
    assert rows(same) == [(1, 1, 3.0, 3.0)]


def test_last_messages(spark, rows):
    table = spark.createDataFrame(
        [("a", i) for i in range(250)] + [("b", i) for i in range(3)], "metric string, n int")
    kept = recent.last_per_key(table, "metric", ["n"])
    assert kept.where("metric = 'a'").agg(F.min("n"), F.count("*")).first() == (150, 100)
    assert kept.where("metric = 'b'").count() == 3
    assert recent.last_overall(table, ["n"], 2).collect() == [("a", 249), ("a", 248)]


def test_dashboards_open_one_snapshot_of_many(spark, tmp_path):
    log = result_folder(str(tmp_path / "log"))
    for epoch in range(6):
        table = spark.createDataFrame([("a", float(epoch))], "l1_category string, total_sales double")
        publish_metrics(log, {"sales_by_category": table}, epoch)
    newest = newest_snapshots(log, spark)
    assert newest == {"sales_by_category": ("batch", 5)}
    everything = readside.result_rows(log.replay(spark), ["l1_category", "total_sales"])
    for found in (readside.of_metric(everything, "sales_by_category", newest=newest),
                  readside.newest_of_all(everything, newest)):
        assert [r.total_sales for r in found.collect()] == [5.0]
        scan = found._jdf.queryExecution().executedPlan().toString()
        (partitions,) = [line for line in scan.split("PartitionFilters: [")[1:2]]
        assert "epoch_id" in partitions.split("]")[0] and "run_id" in partitions.split("]")[0]
        assert len(found.inputFiles()) >= 1


def test_snapshot_published_twice_is_there_once(spark, tmp_path, rows):
    log = result_folder(str(tmp_path / "log"))
    table = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "l1_category string, total_sales double")
    other = spark.createDataFrame([("x", 5)], "city_name string, total_procured_quantity long")
    publish_metrics(log, {"sales_by_category": table, "quantity_by_city": other}, 0)
    publish_metrics(log, {"sales_by_category": table}, 1)
    publish_metrics(log, {"sales_by_category": table.limit(1)}, 1)
    found = readside.result_rows(log.replay(spark), ["l1_category", "total_procured_quantity"])
    assert rows(found.groupBy("metric", "epoch_id").count()) == [
        ("quantity_by_city", 0, 1), ("sales_by_category", 0, 2), ("sales_by_category", 1, 2)]
    assert newest_snapshots(log, spark) == {
        "quantity_by_city": ("batch", 0), "sales_by_category": ("batch", 1)}


def test_export_has_no_nested_columns(results):
    log = results({"metric": "sales_trend", "sales": 1.0,
                   "window": {"start": "2022-04-01T00:00:00.000Z",
                              "end": "2022-04-01T00:10:00.000Z"}})
    flat = readside.flat_results(log)
    assert "window" not in flat.columns
    (row,) = flat.collect()
    assert (row.window_start.minute, row.window_end.minute) == (0, 10)
