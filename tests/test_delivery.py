"""Messages that are there twice, runs that start anew, batches that fail: nothing is lost, nothing
counts double."""

from threading import Barrier

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_streams import FIRST, SECOND

from tillstream.operators import parse, readside
from tillstream.operators.metrics import METRICS, pick
from tillstream.schema import EXACT_MONEY
from tillstream.sources import csv_files
from tillstream.sources.topics import FolderTopic, order_folder, result_folder
from tillstream.streaming import jobs, keyed_source, recent_state, sinks

SCHEMA = T.StructType([T.StructField("metric", T.StringType()),
                       T.StructField("error", T.StringType()),
                       T.StructField("n", T.IntegerType())])


@pytest.fixture
def log(spark, tmp_path):
    """An append-only log and a function that sends texts to it."""
    topic = FolderTopic(str(tmp_path / "log"), "eda_results")

    def send(*texts):
        topic.append(spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1))

    return topic, send


# Identity ----------------------------------------------------------------------------------

def test_distinct_messages_of_one_batch_are_all_kept(spark, log, rows):
    topic, send = log
    batch = ['{"run_id":"r","epoch_id":0,"error":"a"}', '{"run_id":"r","epoch_id":0,"error":"b"}',
             '{"metric":"m","run_id":"r","epoch_id":0,"manufacturer":"x","n":1}',
             '{"metric":"m","run_id":"r","epoch_id":0,"manufacturer":"y","n":1}']
    send(*batch)
    again = [b.replace("{", '{"published_at":"2024-01-01T00:00:00.000Z",', 1) for b in batch]
    send(*again)  # the same batch, published later
    found = readside.all_result_rows(readside.unrepeated(topic.replay(spark)))
    assert rows(found.select("error", "manufacturer")) == [
        ("a", None), ("b", None), (None, "x"), (None, "y")]


def test_what_tells_messages_apart(spark, log, rows):
    topic, send = log
    send('{"message_id":"1","n":1}', '{"message_id":"2","n":1}')
    send('{"message_id":"1","n":1.0000001}')  # a sum of doubles of a batch that ran again
    send('{"error":"down"}', '{"error":"down"}', "not json", "not json", "null", "[1]")
    send('{"run_id":"r","epoch_id":1,"a":1,"b":{"c":2}}', '{"b":{"c":2},"epoch_id":1,"a":1,"run_id":"r"}')
    send('{"run_id":"r","epoch_id":2,"a":1,"b":{"c":2}}')
    kept = readside.unrepeated(topic.replay(spark))
    texts = sorted(r.value.decode() for r in kept.select("value").collect())
    assert len(texts) == 10  # both errors, both texts, null, [1]: no batch could have sent them
    assert '{"message_id":"1","n":1.0000001}' in texts
    assert kept.columns == topic.replay(spark).columns


def test_ids_of_metric_rows(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)],
                                  "l1_category string, total_sales double")
    results = result_folder(str(tmp_path / "r"))
    ids = []
    for scale in (1.0, 1.0000001):
        from tillstream.operators.metrics import result_messages
        messages = result_messages({"sales_by_category": table.withColumn(
            "total_sales", F.col("total_sales") * scale)}, 4, "run")
        ids.append({r.i for r in messages.select(
            F.get_json_object("value", "$.message_id").alias("i")).collect()})
    assert ids[0] == ids[1] and len(ids[0]) == 3
    assert results.name == "eda_results"


def test_fields_named_like_columns_of_the_topic(messages, rows):
    body = {"metric": "m", "topic": "body", "partition": 5, "offset": "o", "timestamp": "t",
            "key": "k"}
    found = readside.all_result_rows(messages(body).withColumns({
        "topic": F.lit("eda_results"), "partition": F.lit(0), "offset": F.lit(0),
        "timestamp": F.current_timestamp(), "key": F.lit(None).cast("binary")}))
    assert rows(found.select("topic", "partition", "offset", "timestamp", "key")) == [
        ("body", 5, "o", "t", "k")]


def test_the_feed_takes_a_repeated_message_once(spark, log, tmp_path, rows):
    topic, send = log

    def run():
        jobs.finish([jobs.start_feed(spark, topic, str(tmp_path / "feed"),
                                     jobs.Run(str(tmp_path / "cp"), jobs.DRAIN), SCHEMA)])

    send('{"metric":"a","n":1,"message_id":"1"}', '{"metric":"a","n":2,"message_id":"2"}')
    send('{"metric":"a","n":1,"message_id":"1"}', '{"error":"x"}', '{"error":"x"}')
    run()
    send('{"metric":"a","n":2,"message_id":"2"}', '{"metric":"a","n":3,"message_id":"3"}')
    run()  # after a restart
    feed = spark.read.parquet(str(tmp_path / "feed/feed"))
    assert rows(feed.select("n")) == [(1,), (2,), (3,)]
    assert rows(spark.read.parquet(str(tmp_path / "feed/errors")).select("error")) == [("x",)] * 2


# Last messages as state ------------------------------------------------------------------------

def start_recent(spark, topic, tmp_path, checkpoint="cp", **options):
    jobs.finish([jobs.start_recent(
        spark, topic, str(tmp_path / "recent"),
        jobs.Run(str(tmp_path / checkpoint), jobs.DRAIN, partitions=2), SCHEMA, **options)])


def last(spark, tmp_path, size=100):
    return recent_state.stored_last_messages(spark, str(tmp_path / "recent"), SCHEMA, size)


def test_state_holds_the_last_messages_over_restarts_and_runs(spark, log, tmp_path, rows):
    topic, send = log
    send(*[f'{{"metric":"a","n":{n},"message_id":"{n}"}}' for n in range(150)], '{"n":7}',
         '{"metric":"b","n":1}', '{"error":"e","metric":"a"}')
    start_recent(spark, topic, tmp_path, order=["n"])
    kept = last(spark, tmp_path)
    assert rows(kept.where("metric = 'a'").select("n")) == sorted(
        [(n,) for n in range(50, 150)], key=repr)
    send(*[f'{{"metric":"a","n":{n},"message_id":"{n}"}}' for n in range(140, 160)])
    start_recent(spark, topic, tmp_path, order=["n"])  # goes on, half of it is repeats
    expected = sorted([("a", n) for n in range(60, 160)] + [("b", 1)], key=repr)
    assert rows(last(spark, tmp_path).select("metric", "n")) == expected
    start_recent(spark, topic, tmp_path, "other", order=["n"])  # a run from the start
    assert rows(last(spark, tmp_path).select("metric", "n")) == expected


def test_arrival_order_of_state(spark, log, tmp_path):
    topic, send = log
    for n in range(3):
        send(f'{{"metric":"a","n":{n}}}')
        start_recent(spark, topic, tmp_path)
    assert [r.n for r in last(spark, tmp_path, 2).orderBy("n").collect()] == [1, 2]


def test_an_expired_list_is_filled_anew(spark, log, tmp_path):
    import time

    topic, send = log
    send('{"metric":"a","n":1}')
    start_recent(spark, topic, tmp_path, order=["n"], expire_ms=1)
    time.sleep(0.1)
    send(*[f'{{"metric":"a","n":{n}}}' for n in range(2, 40)])
    start_recent(spark, topic, tmp_path, order=["n"], expire_ms=60_000)
    stored = spark.read.parquet(str(tmp_path / "recent"))
    newest = stored.where(F.col("batch_id") == stored.agg(F.max("batch_id")).first()[0])
    assert newest.where("o0 = 1").isEmpty() and newest.count() == 38


# A sink that commits -----------------------------------------------------------------------------

def run_keyed(spark, orders, tmp_path, checkpoint="cp"):
    jobs.finish([jobs.start_keyed_source(
        spark, orders, str(tmp_path / "table"),
        jobs.Run(str(tmp_path / checkpoint), jobs.DRAIN, partitions=2))])


def keyed_rows(spark, tmp_path):
    return sinks.latest_orders(keyed_source.committed_rows(spark, str(tmp_path / "table")))


def test_committed_batches_make_the_table(spark, topic, tmp_path, rows):
    orders, send = topic
    send({"order_id": "1", "city_name": "a"}, {"order_id": "2", "city_name": "b"},
         {"city_name": "none"}, "not json")
    run_keyed(spark, orders, tmp_path)
    send({"order_id": "1", "city_name": "c"})
    run_keyed(spark, orders, tmp_path)
    run_keyed(spark, orders, tmp_path)  # nothing new
    found = keyed_rows(spark, tmp_path)
    assert rows(found.select("row_key", "metadata.city_name")) == [("1", "c"), ("2", "b")]
    run_keyed(spark, orders, tmp_path, "other")  # a new checkpoint adds nothing new
    assert rows(keyed_rows(spark, tmp_path).select("row_key", "metadata.city_name")) == [
        ("1", "c"), ("2", "b")]


def test_a_failed_batch_leaves_nothing(spark, topic, tmp_path, rows):
    orders, send = topic
    keyed_source.register(spark)
    send({"order_id": "1"}, {"order_id": "bad"})
    send({"order_id": "2"})

    def start(value):
        text = F.get_json_object(F.col("value").cast("string"), "$.order_id")
        table = orders.stream(spark).select(
            F.when(text == "bad", value).otherwise(text).alias("row_key"))
        return table.writeStream.format(keyed_source.NAME).option(
            "path", str(tmp_path / "t")).option("run", "r").option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    query = start(F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        query.awaitTermination()
    assert not (tmp_path / "t" / "commits").exists()
    start(F.lit("3")).awaitTermination()
    found = keyed_source.committed_rows(spark, str(tmp_path / "t"))
    assert rows(found.select("row_key")) == [("1",), ("2",), ("3",)]


def test_a_batch_committed_before_a_restart_is_not_added_again(tmp_path):
    import pyarrow as pa

    writer = keyed_source.KeyedOrdersWriter(str(tmp_path), "r")
    batch = pa.RecordBatch.from_arrays([pa.array(["1"])], names=["row_key"])
    for _ in range(2):
        writer.commit([writer.write(iter([batch])), writer.write(iter([])), None], 0)
    writer.abort([writer.write(iter([batch]))], 1)
    assert len(list((tmp_path / "files").glob("*.parquet"))) == 1
    assert [p.name for p in (tmp_path / "commits").iterdir() if p.suffix == ".json"] == ["r-0.json"]


# Throttle, landing -------------------------------------------------------------------------------

def test_a_limit_is_a_number_of_messages(spark, tmp_path):
    orders = order_folder(str(tmp_path / "orders"), per_file=5)
    rows = spark.range(23).select(F.to_json(F.struct(F.col("id").alias("order_id"))).alias("value"))
    orders.append(rows.coalesce(1))
    query = jobs.start_landing(spark, orders, str(tmp_path / "d"), jobs.Run(
        str(tmp_path / "cp"), jobs.DRAIN, limit=10))
    jobs.finish([query])
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] in (
        [10, 10, 3], [10, 8, 5], [8, 10, 5])
    with pytest.raises(ValueError):
        orders.stream(spark, 4)


def test_variants_are_landed_whole_and_read_by_path(spark, topic, tmp_path, rows):
    orders, send = topic
    send(*FIRST, {"order_id": 7, "extra": {"deep": [1, 2]}, "unit_selling_price": 1.5}, "[1]")
    jobs.finish([jobs.start_variant_landing(
        spark, orders, str(tmp_path / "d"), jobs.Run(str(tmp_path / "cp"), jobs.DRAIN))])
    documents = spark.read.parquet(str(tmp_path / "d"))
    assert rows(documents.where("raw IS NOT NULL").select("raw")) == [("[1]",), ("not json",)]
    found = parse.variant_lines(documents, EXACT_MONEY)
    assert rows(found) == rows(parse.parse_orders(orders.replay(spark), EXACT_MONEY))
    deep = documents.where("document IS NOT NULL").select(
        F.try_variant_get("document", "$.extra.deep[1]", "int").alias("x")).where("x IS NOT NULL")
    assert rows(deep) == [(2,)]
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "from_json" not in plan and "parse_json" not in plan and "jsontostructs" not in plan


# Changed totals ------------------------------------------------------------------------------------

def start_changes(spark, orders, path, checkpoint, caught_up=True):
    query = jobs.start_metric_changes(spark, orders, path, jobs.Run(
        checkpoint, jobs.DRAIN, money=EXACT_MONEY))
    if caught_up:
        jobs.finish_changes(spark, query, path)
    else:
        jobs.finish([query])
    return str(query.id)


def test_totals_stay_right_while_a_new_run_catches_up(spark, topic, tmp_path, rows):
    orders, send = topic
    path = str(tmp_path / "totals")
    sales = lambda: rows(pick(sinks.current_totals(spark, path), METRICS["sales_by_category"]))
    send(*FIRST)
    part = order_folder(str(tmp_path / "part"))
    part.append(orders.replay(spark))  # what the new run has read so far
    send(*SECOND)
    old = start_changes(spark, orders, path, str(tmp_path / "old"))
    before = sales()
    start_changes(spark, part, path, str(tmp_path / "new"), caught_up=False)
    assert sales() == before and sinks.current_run(spark, path) == old
    send({"l1_category": "z", "unit_selling_price": "9"})
    new = start_changes(spark, orders, path, str(tmp_path / "third"))
    assert sinks.current_run(spark, path) == new and ("z", 9.0) in sales()
    start_changes(spark, orders, path, str(tmp_path / "old"))  # an old run takes nothing back
    assert sinks.current_run(spark, path) == new


def test_before_any_run_has_caught_up_the_first_one_counts(spark, topic, tmp_path):
    orders, send = topic
    path = str(tmp_path / "totals")
    assert sinks.current_run(spark, path) is None
    send(*FIRST)
    first = start_changes(spark, orders, path, str(tmp_path / "a"), caught_up=False)
    start_changes(spark, orders, path, str(tmp_path / "b"), caught_up=False)
    assert sinks.current_run(spark, path) == first


def test_a_live_run_takes_over_when_it_has_caught_up(spark, topic, tmp_path):
    orders, send = topic
    path = str(tmp_path / "totals")
    send(*FIRST)
    query = jobs.start_metric_changes(spark, orders, path, jobs.Run(
        str(tmp_path / "cp"), {"processingTime": "100 milliseconds"}))
    import threading
    import time

    done = threading.Thread(target=jobs.run_until_any_ends, args=(spark, [query], [path]))
    done.start()
    for _ in range(300):
        if (tmp_path / "totals/_generations" / str(query.id) / "_SUCCESS").exists():
            break
        time.sleep(0.1)
    query.stop()
    done.join()
    assert sinks.current_run(spark, path) == str(query.id)
    assert (tmp_path / "totals/_generations" / str(query.id)).exists()


def test_compacted_totals_go_on(spark, topic, tmp_path, rows):
    orders, send = topic
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    send(*FIRST)
    start_changes(spark, orders, old, str(tmp_path / "cp"))
    send({"l1_category": "a", "unit_selling_price": "5", "city_name": "x"})
    start_changes(spark, orders, old, str(tmp_path / "cp"))
    sinks.compact_totals(spark, old, new)
    stored = spark.read.parquet(new)
    assert stored.count() == sinks.current_totals(spark, old).count() < spark.read.parquet(old).count()
    send(*SECOND)
    start_changes(spark, orders, new, str(tmp_path / "cp"))
    table = parse.parse_orders(orders.replay(spark), EXACT_MONEY)
    totals = sinks.current_totals(spark, new)
    for name, metric in METRICS.items():
        assert rows(pick(totals, metric)) == rows(metric.compute(table)), name


# The table in SQL ------------------------------------------------------------------------------------

def test_a_lookup_by_sql_opens_one_bucket(spark, topic, tmp_path, rows):
    orders, send = topic
    path = str(tmp_path / "table")
    for _ in range(2):
        sinks.create_orders_table(spark, "some_orders", path)  # before there is anything
    send(*[{"order_id": str(n), "city_name": "a"} for n in range(60)])
    run = jobs.Run(str(tmp_path / "cp"), jobs.DRAIN)
    jobs.finish([jobs.start_upsert(spark, orders, path, run)])
    send({"order_id": "7", "city_name": "b"})
    jobs.finish([jobs.start_upsert(spark, orders, path, run)])
    assert spark.table("some_orders").count() == 60
    found = spark.sql("SELECT row_key, metadata.city_name FROM some_orders_of('7')")
    assert rows(found) == [("7", "b")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and "= " in filters and "xxhash64" not in filters
    assert rows(spark.sql("SELECT * FROM some_orders_of('no')")) == []


def test_bucketed_tables_are_joined_where_they_lie(spark, tmp_path, rows):
    left = spark.range(50).select(F.col("id").cast("string").alias("row_key"), "id")
    right = spark.range(100).select((F.col("id") % 50).cast("string").alias("row_key"))
    sinks.save_bucketed(left, "left_rows", str(tmp_path / "l"), buckets=4)
    sinks.save_bucketed(right, "right_rows", str(tmp_path / "r"), buckets=4)
    joined = spark.table("left_rows").hint("merge").join(
        spark.table("right_rows").groupBy("row_key").count(), "row_key")
    assert joined.count() == 50
    joined.collect()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


# Top lists and late lines ----------------------------------------------------------------------------

def brand_lines(*brands):
    return [{"brand_name": brand, "order_id": "1"} for brand in brands]


def test_a_top_list_is_kept_up_from_changed_buckets(spark, topic, tmp_path, rows):
    orders, send = topic
    path, metric = str(tmp_path / "best"), METRICS["top_brands"]

    def run():
        jobs.finish_changes(spark, jobs.start_best(
            spark, orders, path, jobs.Run(str(tmp_path / "cp"), jobs.DRAIN), "top_brands"),
            f"{path}/totals")

    def same():
        table = parse.parse_orders(orders.replay(spark), EXACT_MONEY)
        found = sinks.current_best(spark, path, metric)
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in metric.compute(table).collect()]

    send(*brand_lines(*[f"b{n}" for n in range(300) for _ in range(1 + n % 13)]), {"order_id": "2"})
    run()
    same()
    send(*brand_lines(*["b7"] * 40))  # one key: one bucket is written and ranked
    run()
    same()
    written = lambda batch: sum(f.stat().st_size for f in (tmp_path / "best").rglob(
        f"batch_id={batch}/bucket=*/*.parquet"))
    assert len(list((tmp_path / "best/best").rglob("batch_id=1/bucket=*"))) == 1
    assert written(1) * 5 < written(0)
    lists = spark.read.parquet(f"{path}/best")
    assert lists.groupBy("batch_id", "bucket").count().agg(F.max("count")).first()[0] <= 10
    with pytest.raises(ValueError):
        jobs.start_best(spark, orders, path, jobs.Run("x", jobs.DRAIN), "orders_by_city")


def test_late_lines_are_kept_and_restated(spark, topic, tmp_path, rows):
    orders, send = topic
    path, metric = str(tmp_path / "trend"), METRICS["sales_trend"]
    line = lambda time, amount: {
        "l1_category": "a", "date_": f"2022-04-01 {time}:00", "unit_selling_price": amount}

    def run():
        jobs.finish([jobs.start_trend(spark, orders, path, jobs.Run(
            str(tmp_path / "cp"), jobs.DRAIN, money=EXACT_MONEY), "1 hour")])

    def trend(corrected=True):
        found = sinks.stored_trend(spark, path, metric, corrected)
        return rows(found.select(F.date_format("window.start", "HH:mm"), F.col("sales")))

    sinks.restate_trend(spark, path, metric)  # nothing there yet
    send(line("10:00", "1"), line("12:00", "2"), {"l1_category": "a", "unit_selling_price": "9"})
    run()
    send(line("10:05", "4"), line("10:55", "8"), line("11:05", "16"), line("12:30", "32"))
    run()
    # Windows that end by 11:00 were closed; the last one of them ends at 11:00 itself.
    assert trend(False) == [("10:00", 1.0), ("11:00", 16.0), ("12:00", 2.0), ("12:30", 32.0)]
    assert spark.read.parquet(f"{path}/late").count() == 2
    sinks.restate_trend(spark, path, metric)
    sinks.restate_trend(spark, path, metric)  # adds nothing twice
    send(line("11:06", "64"), line("10:01", "128"))
    run()
    assert trend(False)[0] == ("10:00", 1.0)
    sinks.restate_trend(spark, path, metric)
    table = parse.parse_orders(orders.replay(spark), EXACT_MONEY)
    assert trend() == rows(metric.compute(table).select(
        F.date_format("window.start", "HH:mm"), F.col("sales")))


# Rejects, sketches, preparation as it arrives -----------------------------------------------------------

def test_every_message_is_kept_or_rejected_with_its_reasons(spark, topic, tmp_path, rows):
    from tillstream.operators import rejects

    orders, send = topic
    send({"order_id": "1", "unit_selling_price": "2.5"}, {"unit_selling_price": "x", "cart_id": "y"},
         "not json", "[1]", {"order_id": "", "procured_quantity": "many"}, {"order_id": "0"})
    jobs.finish([jobs.start_checked(
        spark, orders, str(tmp_path / "checked"), jobs.Run(str(tmp_path / "cp"), jobs.DRAIN))])
    judged = spark.read.parquet(str(tmp_path / "checked"))
    assert rows(judged.groupBy("verdict").count()) == [("kept", 2), ("rejected", 4)]
    assert rows(rejects.reason_counts(judged)) == [
        ("kept", 2), ("no_key", 2), ("not_json", 2), ("read", 6), ("unread:cart_id", 1),
        ("unread:procured_quantity", 1), ("unread:unit_selling_price", 1)]
    assert "not json" in {r.raw for r in rejects.rejected(judged).collect()}
    assert rejects.REASONS not in rejects.kept(judged).columns
    cells = spark.createDataFrame([("1", "NA"), ("x", None), ("", "y"), ("a", "b")], "`a.b` string, c string")
    assert rows(rejects.reason_counts(rejects.judge_cells(cells))) == [
        ("kept", 1), ("missing:a.b", 1), ("missing:c", 2), ("read", 4)]


def test_sketches_of_parts_merge_to_one_of_the_whole(spark):
    from tillstream.operators import readside, sketches

    table = spark.range(50_000).select(
        (F.col("id") % 7).alias("epoch"), (F.col("id") * F.col("id") % 9973).cast("double").alias("v"))
    merged = sketches.merge(sketches.sketch(table.union(spark.createDataFrame(
        [(3, None)], "epoch long, v double")), ["epoch"], "v"))
    exact = {r.bin: r.customers for r in readside.histogram(table, "v").collect()}
    close = {r.bin: r.customers for r in sketches.histogram(merged).collect()}
    assert set(exact) == set(close)
    assert all(abs(exact[b] - close[b]) <= 2 * sketches.RANK_ERROR * 50_000 + 1 for b in exact)
    middle = merged.select(sketches.quantile(0.5).alias("m"), "n").first()
    assert middle.n == 50_000 and abs(middle.m - 4986) < 2 * sketches.RANK_ERROR * 9973 + 60
    same = sketches.histogram(sketches.merge(sketches.sketch(
        table.withColumn("v", F.lit(2.0)), ["epoch"], "v")))
    assert [tuple(r) for r in same.collect()] == [(1, 50_000, 2.0, 2.0)]


def test_sales_wait_for_their_product(spark, tmp_path, rows):
    from tillstream.sources.csv_files import write_csv

    def send(name, *values):
        columns = ["product_id", "name"] if name == "products" else ["product_id", "sale", "name"]
        write_csv(spark.createDataFrame(values, ", ".join(f"{c} string" for c in columns)).coalesce(1),
                  str(tmp_path / name), "append")

    def run():
        jobs.finish([jobs.start_preparation(
            spark, str(tmp_path / "sales"), str(tmp_path / "products"), str(tmp_path / "rows"),
            jobs.Run(str(tmp_path / "cp"), jobs.DRAIN, partitions=2))])
        return rows(spark.read.parquet(str(tmp_path / "rows")).select("sale", "name_x", "name_y"))

    send("sales", ("1", "a", "s"), ("2", "b", "s"), ("2", "NA", "s"), ("05", "c", "s"))
    send("products", ("1", "one"), ("3", "three"))
    assert run() == [("a", "s", "one")]
    send("products", ("2", "two"), ("5.0", "five"), ("6", "NA"))
    assert run() == [("a", "s", "one"), ("b", "s", "two"), ("c", "s", "five")]
    send("sales", ("3", "d", "s"), ("6", "e", "s"))  # its product came long before; none is complete
    assert run() == [("a", "s", "one"), ("b", "s", "two"), ("c", "s", "five"), ("d", "s", "three")]


def test_writes_of_a_batch_run_side_by_side(spark):
    context = spark.sparkContext
    context.setLocalProperty("sql.streaming.queryId", "q")
    meet, seen = Barrier(3, timeout=60), []

    def write(n):
        meet.wait()  # never passed if one write had to end before the next
        seen.append((n, sinks.run_id(spark.range(n))))
        if n == 1:
            raise ValueError("lost")

    try:
        with pytest.raises(ValueError, match="lost"):
            sinks._at_once(spark.range(1), [lambda n=n: write(n) for n in range(3)])
    finally:
        context.setLocalProperty("sql.streaming.queryId", None)
    assert sorted(seen) == [(0, "q"), (1, "q"), (2, "q")]


def test_the_feed_keeps_its_state_on_disk(spark, log, tmp_path):
    from tillstream.session import STATE_PROVIDER

    topic, send = log
    send('{"metric":"a","n":1}', '{"error":"e"}')
    before = spark.conf.get(STATE_PROVIDER)
    spark.conf.set(STATE_PROVIDER, before.replace("RocksDB", "HDFSBacked"))
    try:
        query = jobs.start_feed(spark, topic, str(tmp_path / "feed"), jobs.Run(
            str(tmp_path / "cp"), jobs.DRAIN, partitions=2), SCHEMA)
        jobs.finish([query])
    finally:
        spark.conf.set(STATE_PROVIDER, before)
    state = query.recentProgress[0]["stateOperators"][0]
    assert any(name.startswith("rocksdb") for name in state["customMetrics"])
    assert state["numRowsTotal"] == 2
    version = sinks.recent_versions(spark, str(tmp_path / "feed/recent"))[-1]
    assert (version.slot, version.run_id, version.batch_id) == (0, str(query.id), 0)


def test_waiting_sales_are_kept_closely_and_whole(spark, tmp_path, rows):
    odd = ('a "b", c', "back\\slash", "[1]", "{}", "é\u2028\t", " NA ", "null ", "'", "\\u0041", "0")
    for folder, table in (
            ("sales", spark.createDataFrame([("5", t, t[::-1]) for t in odd], "product_id string, t string, r string")),
            ("products", spark.createDataFrame([("5", "tea")], "product_id string, r string"))):
        csv_files.write_csv(table.coalesce(1), str(tmp_path / folder), packed=True)
    query = jobs.start_preparation(
        spark, str(tmp_path / "sales"), str(tmp_path / "products"), str(tmp_path / "rows"),
        jobs.Run(str(tmp_path / "cp"), jobs.DRAIN, partitions=1))
    jobs.finish([query])
    found = spark.read.parquet(str(tmp_path / "rows"))
    assert found.columns == ["product_id", "t", "r_x", "r_y"]
    assert rows(found) == sorted((("5", t, t[::-1], "tea") for t in odd), key=repr)
    assert all(".zstd." in name for name in found.inputFiles())
    text = query._jsq.explainInternal(False)
    joined = text[text.index("StreamingSymmetricHashJoin"):]
    assert "__sale#" in joined and "r_x#" not in joined


def test_the_feed_keeps_the_run_a_message_names(spark, log, tmp_path, rows):
    from tillstream.schema import RESULT_SCHEMA

    topic, send = log
    for n in range(2):
        send(f'{{"metric":"top_brands","run_id":"r{n}","epoch_id":0,"message_id":"{n}"}}')
        jobs.finish([jobs.start_feed(spark, topic, str(tmp_path / "feed"), jobs.Run(
            str(tmp_path / "cp"), jobs.DRAIN), RESULT_SCHEMA)])
    for found in (spark.read.parquet(str(tmp_path / "feed/feed")),
                  sinks.recent_rows(spark, str(tmp_path / "feed/recent"))):
        assert rows(found.select("message_run_id")) == [("r0",), ("r1",)]
