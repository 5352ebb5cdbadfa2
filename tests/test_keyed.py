import pytest
from pyspark.sql import functions as F

from tillstream.operators import keyed
from tillstream.schema import FIELD_NAMES
from tillstream.sources.topics import FolderTopic
from tillstream.streaming import jobs, sinks


def test_last_line_of_an_order_wins(lines, rows):
    table = keyed.upsert(lines(
        {"order_id": 1, "city_name": "a", "procured_quantity": 1},
        {"order_id": 1, "city_name": "b", "procured_quantity": 5},
        {"order_id": 2, "city_name": "c", "procured_quantity": 2},
    ), order=["procured_quantity"])
    assert rows(table.select("row_key", "metadata.city_name")) == [("1", "b"), ("2", "c")]


def test_whole_row_is_replaced_including_nulls(lines, rows):
    table = keyed.upsert(lines(
        {"order_id": 1, "city_name": "a", "procured_quantity": 1},
        {"order_id": 1, "city_name": None, "procured_quantity": 5},
    ), order=["procured_quantity"])
    assert rows(table.select("metadata.city_name", "pricing.procured_quantity")) == [(None, 5)]


def test_families_hold_all_fields(lines):
    table = keyed.to_families(lines({"order_id": 7}))
    assert table.columns == ["row_key", *keyed.FAMILIES]
    assert table.select(*keyed.family_fields()).columns == list(FIELD_NAMES)
    (row,) = table.collect()
    assert row.row_key == "7" and row.order_data.order_id == 7
    assert len(row.product_data) == 12 and len(row.pricing) == 4


def upsert(spark, orders, tmp_path, **options):
    query = jobs.start_upsert(
        spark, orders, str(tmp_path / "table"), jobs.Run(str(tmp_path / "cp"), jobs.DRAIN),
        **options)
    jobs.finish([query])
    return query


def stored(spark, tmp_path, **options):
    return sinks.latest_orders(spark.read.parquet(str(tmp_path / "table")), **options)


def test_stream_keeps_the_message_that_came_last(spark, topic, tmp_path, rows):
    orders, send = topic
    send({"order_id": "1", "city_name": "z"}, {"order_id": "2", "city_name": "z"})
    upsert(spark, orders, tmp_path)
    send({"order_id": "1", "city_name": "a"})
    upsert(spark, orders, tmp_path)
    assert rows(stored(spark, tmp_path).select("row_key", "metadata.city_name")) == [
        ("1", "a"), ("2", "z")]
    # By a field instead of by arrival.
    by_city = stored(spark, tmp_path, order_by=["city_name"])
    assert rows(by_city.select("row_key", "metadata.city_name")) == [("1", "z"), ("2", "z")]


def test_two_messages_of_one_batch(spark, topic, tmp_path, rows):
    orders, send = topic
    send({"order_id": "1", "city_name": "z"})
    send({"order_id": "1", "city_name": "a"})
    upsert(spark, orders, tmp_path)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1
    assert rows(stored(spark, tmp_path).select("metadata.city_name")) == [("a",)]


def test_lines_without_a_key_are_left_out_and_counted(spark, topic, tmp_path, rows):
    orders, send = topic
    send({"order_id": None}, {"order_id": ""}, {"order_id": "0"}, "not json", {"order_id": 3})
    query = upsert(spark, orders, tmp_path)
    assert rows(stored(spark, tmp_path).select("row_key")) == [("0",), ("3",)]
    counted = [p.observedMetrics["upsert_input"] for p in query.recentProgress
               if "upsert_input" in p.observedMetrics]
    assert [(c["lines"], c["without_key"]) for c in counted] == [(5, 3)]


def test_restart_adds_nothing(spark, topic, tmp_path):
    orders, send = topic
    send({"order_id": "1"})
    upsert(spark, orders, tmp_path)
    upsert(spark, orders, tmp_path)
    assert spark.read.parquet(str(tmp_path / "table")).select("batch_id").distinct().count() == 1


def test_batch_that_runs_twice_is_stored_once(spark, tmp_path, lines):
    batch = lines({"order_id": 1}, {"order_id": 2}).withColumn("position", F.struct(F.lit(1)))
    write = sinks.upsert_sink(str(tmp_path / "table"))
    write(batch, 4)
    write(batch, 4)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_compaction_keeps_the_table(spark, topic, tmp_path, rows):
    orders, send = topic
    for city in "abc":
        send({"order_id": "1", "city_name": city}, {"order_id": city})
        upsert(spark, orders, tmp_path)
    before = rows(stored(spark, tmp_path).drop("position"))
    sinks.compact_orders(spark, str(tmp_path / "table"), str(tmp_path / "compact"))
    compact = spark.read.parquet(str(tmp_path / "compact"))
    assert compact.count() == 4

    def now():
        table = spark.read.parquet(str(tmp_path / "compact"))
        return rows(sinks.latest_orders(table).drop("position"))

    assert now() == before
    # The last batch runs again, into the new folder; then a new one comes.
    again = spark.read.parquet(str(tmp_path / "table")).where("batch_id = 2").drop(
        "run_id", "batch_id", "stored_at")
    sinks.rows_sink(str(tmp_path / "compact"), "bucket")(again, 2)
    assert now() == before
    send({"order_id": "1", "city_name": "d"})
    query = jobs.start_upsert(
        spark, orders, str(tmp_path / "compact"), jobs.Run(str(tmp_path / "cp"), jobs.DRAIN))
    jobs.finish([query])
    assert [row.metadata.city_name for row in sinks.latest_orders(
        spark.read.parquet(str(tmp_path / "compact"))).where("row_key = '1'").collect()] == ["d"]


def test_compaction_by_field(spark, topic, tmp_path):
    orders, send = topic
    for city in "ba":
        send({"order_id": "1", "city_name": city})
        upsert(spark, orders, tmp_path, order_by=["city_name"])
    sinks.compact_orders(spark, str(tmp_path / "table"), str(tmp_path / "compact"), ["city_name"])
    (row,) = spark.read.parquet(str(tmp_path / "compact")).collect()
    assert row.metadata.city_name == "b"


def test_create_table_only_once(spark, topic, tmp_path, rows):
    orders, send = topic
    send({"order_id": "1", "city_name": "a"})
    upsert(spark, orders, tmp_path)
    for _ in range(2):
        keyed.create_keyed_table(spark, "ecommerce_data", str(tmp_path / "table"))
    try:
        found = lambda: rows(spark.table("ecommerce_data").select(
            "row_key", "metadata.city_name"))
        assert found() == [("1", "a")]
        send({"order_id": "1", "city_name": "b"}, {"order_id": "2"})
        upsert(spark, orders, tmp_path)
        assert found() == [("1", "b"), ("2", None)]  # one row per order, new batches included
    finally:
        spark.sql("DROP VIEW ecommerce_data")


def test_table_before_the_first_batch_is_empty(spark, tmp_path):
    keyed.create_keyed_table(spark, "no_orders", str(tmp_path / "table"))
    try:
        assert spark.table("no_orders").columns[0] == "row_key"
        assert spark.table("no_orders").count() == 0
    finally:
        spark.sql("DROP VIEW no_orders")


def test_new_checkpoint_keeps_stored_orders(spark, topic, tmp_path, rows):
    orders, send = topic
    send({"order_id": "1"}, {"order_id": "2"})
    upsert(spark, orders, tmp_path)
    other = FolderTopic(str(tmp_path / "other"), "ecommerce")
    other.append(spark.createDataFrame([('{"order_id": "3"}',)], "value string"))
    jobs.finish([jobs.start_upsert(
        spark, other, str(tmp_path / "table"), jobs.Run(str(tmp_path / "cp2"), jobs.DRAIN))])
    assert rows(stored(spark, tmp_path).select("row_key")) == [("1",), ("2",), ("3",)]


def test_lookup_opens_the_buckets_of_its_keys_only(spark, topic, tmp_path, rows):
    orders, send = topic
    send(*[{"order_id": str(i)} for i in range(60)])
    upsert(spark, orders, tmp_path)
    path = str(tmp_path / "table")
    found = sinks.lookup_orders(spark, path, ["7"])
    assert rows(found.select("row_key")) == [("7",)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert rows(sinks.lookup_orders(spark, path, ["7", "8", "x"]).select("row_key")) == [
        ("7",), ("8",)]


def test_failing_batch_fails_the_job(spark, topic, tmp_path):
    orders, send = topic
    send({"order_id": "1"})
    (tmp_path / "table").write_text("a file where the folder should be")
    with pytest.raises(Exception):
        upsert(spark, orders, tmp_path)
    # Nothing was skipped: with the fault gone the same batch is stored.
    (tmp_path / "table").rename(tmp_path / "moved")
    upsert(spark, orders, tmp_path)
    assert stored(spark, tmp_path).count() == 1
