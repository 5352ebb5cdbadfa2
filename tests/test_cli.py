"""The commands one after another, from raw files to the exported results."""

import pytest

from tillstream import cli
from tillstream.operators.metrics import METRICS
from tillstream.schema import FIELD_NAMES
from tillstream.sources.csv_files import read_csv
from tillstream.sources.topics import KafkaTopic
from tillstream.streaming import sinks

PRODUCT = FIELD_NAMES[:12]
SALE = ("product_id", *FIELD_NAMES[12:])


def test_from_files_to_results(spark, tmp_path, rows):
    def csv(name, columns, *values):
        lines = [",".join(["Unnamed: 0", *columns])]
        lines += [",".join([str(i), *row]) for i, row in enumerate(values)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")

    csv("products.csv", PRODUCT, ["1", "Milk", "1 l", "dairy", "B", "M", "a", "b", "c", "1", "2", "3"])
    date = "2022-04-01 10:00:00"
    csv("sales.csv", SALE,
        ["1", date, "Pune", "10", "20", "30", "2", "5.5", "0.5", "4.0"],
        ["1", date, "Pune", "11", "21", "30", "1", "4.5", "NA", "4.0"],
        ["1", date, "Delhi", "12", "22", "31", "3", "5.0", "0.0", "4.0"],
        ["2", date, "Delhi", "13", "23", "31", "3", "5.0", "0.0", "4.0"])

    def run(command, streaming=False, **options):
        given = [word for name, value in options.items() for word in (f"--{name}", value)]
        if streaming:
            given += ["--checkpoint", str(tmp_path / "cp"), "--partitions", "2"]
        cli.main([command, *given])

    at = lambda name: str(tmp_path / name)
    run("prepare", sales=at("sales.csv"), products=at("products.csv"), out=at("rows"))
    run("publish", rows=at("rows"), orders=at("orders"))
    run("metrics", True, orders=at("orders"), results=at("results"))
    run("store", True, orders=at("orders"), table=at("table"))
    run("land", True, orders=at("orders"), path=at("documents"))
    run("feed", True, results=at("results"), path=at("feed"))
    run("export", results=at("results"), out=at("export"))

    assert read_csv(spark, at("rows")).count() == 2
    table = sinks.latest_orders(spark.read.parquet(at("table")))
    assert rows(table.select("row_key", "product_data.product_name")) == [
        ("10", "Milk"), ("12", "Milk")]
    assert spark.read.parquet(at("documents")).count() == 2
    exported = read_csv(spark, at("export"))
    run("compact", table=at("table"), out=at("compact"))
    assert spark.read.parquet(at("compact")).count() == 2
    assert rows(exported.where("metric = 'quantity_by_city'").select(
        "city_name", "total_procured_quantity")) == [("Delhi", "3"), ("Pune", "2")]
    assert spark.read.parquet(at("feed/feed")).count() == exported.count()


def test_commands_for_upkeep(spark, tmp_path, rows):
    from tillstream.sources.topics import order_folder

    at = lambda name: str(tmp_path / name)
    order_folder(at("orders")).append(spark.createDataFrame([
        ('{"order_id":"1","brand_name":"b","dim_customer_key":"1","unit_selling_price":"2",'
         '"l1_category":"a","date_":"2022-04-01 10:00:00"}',), ("not json",)], "value string"))

    def run(command, streaming=True, *more, **options):
        given = [word for name, value in options.items() for word in (f"--{name}", value)]
        if streaming:
            given += ["--checkpoint", at(f"cp-{command}"), "--partitions", "2"]
        cli.main([command, *given, *more])

    run("check", orders=at("orders"), path=at("checked"))
    assert rows(spark.read.parquet(at("checked")).select("verdict")) == [("kept",), ("rejected",)]
    run("best", orders=at("orders"), path=at("best"))
    best = sinks.current_best(spark, at("best/top_brands"), METRICS["top_brands"])
    assert rows(best) == [("b", 1), (None, 0)]
    run("trend", orders=at("orders"), path=at("trend"), lateness="1 hour")
    run("correct-trend", False, path=at("trend"))
    assert rows(sinks.stored_trend(spark, at("trend"), METRICS["sales_trend"]).select("sales")) == [(2.0,)]
    run("land", True, "--variant", orders=at("orders"), path=at("documents"))
    assert spark.read.parquet(at("documents")).where("raw = 'not json'").count() == 1
    run("changes", orders=at("orders"), path=at("totals"))
    run("compact-totals", False, path=at("totals"), out=at("compacted"))
    assert rows(sinks.current_totals(spark, at("compacted"))) == rows(
        sinks.current_totals(spark, at("totals")))
    run("store", orders=at("orders"), table=at("table"))
    run("create-table", False, table=at("table"), name="cli_orders")
    assert rows(spark.sql("SELECT row_key FROM cli_orders_of('1')")) == [("1",)]
    run("metrics", orders=at("orders"), results=at("results"))
    run("sketch", results=at("results"), path=at("sketches"))
    assert spark.read.parquet(at("sketches")).select("n").collect() == [(1,)]


def test_topic_addresses():
    topic = cli._topic("kafka://broker:9092/ecommerce")
    assert topic == KafkaTopic("broker:9092", "ecommerce", "earliest")
    topic = cli._topic("kafka://broker:9092/x", True, "latest", ["kafka.security.protocol=SSL"])
    assert topic == KafkaTopic("broker:9092", "x", "latest", {"kafka.security.protocol": "SSL"})


@pytest.mark.parametrize("command, extra", [
    ("metrics", ["--results", "r"]), ("changes", ["--path", "p"]), ("store", ["--table", "t"]),
    ("land", ["--path", "p"])])
def test_commands_read_a_topic_from_its_start_unless_asked(command, extra):
    given = [command, "--orders", "kafka://b:1/o", "--checkpoint", "c", *extra]
    assert cli._parser().parse_args(given).starting == "earliest"
    assert cli._parser().parse_args([*given, "--starting", "latest"]).starting == "latest"
