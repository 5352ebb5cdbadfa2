"""The jobs as commands, for spark-submit:

    prepare   raw sales and product files -> complete order rows
    publish   order rows -> order topic
    metrics   order topic -> result topic
    changes   order topic -> table of changed totals
    store     order topic -> keyed table
    best      order topic -> top lists, kept up incrementally
    trend     order topic -> sales trend, late lines apart
    correct-trend   late lines -> their windows of the trend
    check     order topic -> kept and rejected messages, with reasons
    sketch    result topic -> sketches of the customers' mean order values
    compact   keyed table -> keyed table without outdated rows
    compact-totals  changed totals -> current totals
    create-table    keyed table -> catalog table that SQL can query
    land      order topic -> documents
    feed      result topic -> feed, errors and recent messages
    export    result topic -> CSV

A topic is a folder, or kafka://server:port/name. A streaming command takes what has arrived
since its last run and ends; with --live it keeps going until its first query ends. A Kafka
topic is read from its start (--starting earliest) unless asked otherwise.
"""

from __future__ import annotations

import argparse
from dataclasses import replace
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from tillstream.operators import readside
from tillstream.operators.metrics import METRICS
from tillstream.operators.prepare import prepare
from tillstream.schema import EXACT_MONEY, RESULT_SCHEMA
from tillstream.session import build_session
from tillstream.sources.csv_files import read_csv, write_csv
from tillstream.sources.topics import (
    FolderTopic, KafkaTopic, Topic, order_folder, order_payload, result_folder,
)
from tillstream.streaming import jobs, sinks


def _topic(
    address: str, results: bool = False, starting: str = "earliest",
    options: list[str] | None = None,
) -> Topic:
    if address.startswith("kafka://"):
        parts = urlparse(address)
        settings = dict(option.split("=", 1) for option in options or [])
        return KafkaTopic(parts.netloc, parts.path.strip("/"), starting, settings)
    return result_folder(address) if results else order_folder(address)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(
        prog="tillstream", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *required: str, streaming: bool = False) -> argparse.ArgumentParser:
        added = commands.add_parser(name)
        for option in required:
            added.add_argument(f"--{option}", required=True)
        if streaming:
            added.add_argument("--checkpoint", required=True)
            added.add_argument("--live", action="store_true")
            added.add_argument("--limit", type=int, help="files or messages per batch")
            added.add_argument("--partitions", type=int, help="shuffle and state partitions")
            added.add_argument("--exact-money", action="store_true",
                               help="prices as decimals with four places, for exact sums")
            added.add_argument("--starting", default="earliest",
                               help="where a first run begins: earliest, latest or offsets")
            added.add_argument("--source-option", action="append", metavar="NAME=VALUE",
                               help="option of the Kafka source or sink; may be repeated")
        return added

    for name, required in (("prepare", ("sales", "products", "out")), ("publish", ("rows", "orders"))):
        command(name, *required).add_argument(
            "--multi-line", action="store_true", help="cells may contain line breaks")
    command("metrics", "orders", "results", streaming=True).add_argument(
        "--per-metric", action="store_true", help="a query per metric instead of one for all")
    command("changes", "orders", "path", streaming=True)
    for name in ("best", "check"):
        command(name, "orders", "path", streaming=True)
    command("trend", "orders", "path", streaming=True).add_argument(
        "--lateness", default="1 day", help="how long windows stay open")
    command("sketch", "results", "path", streaming=True)
    command("correct-trend", "path")
    command("compact", "table", "out")
    command("compact-totals", "path", "out")
    command("create-table", "table", "name")
    command("store", "orders", "table", streaming=True).add_argument("--key", default="order_id")
    command("land", "orders", "path", streaming=True).add_argument(
        "--variant", action="store_true", help="documents of any shape, read by path")
    command("feed", "results", "path", streaming=True).add_argument(
        "--repeats-within", default="1 day", help="how long to remember messages, to take each once")
    command("export", "results", "out")
    return parser


def main(arguments: list[str] | None = None) -> None:
    options = _parser().parse_args(arguments)
    spark = build_session(f"tillstream {options.command}")
    if "checkpoint" in options:
        _stream(spark, options)
    elif options.command == "prepare":
        sales = read_csv(spark, options.sales, options.multi_line)
        products = read_csv(spark, options.products, options.multi_line)
        write_csv(prepare(sales, products), options.out)
    elif options.command == "publish":
        rows = read_csv(spark, options.rows, options.multi_line)
        payload = order_payload(rows, blank="")  # a blank cell is an empty text
        _topic(options.orders).append(rows.select(payload.alias("value")))
    elif options.command == "compact":
        sinks.compact_orders(spark, options.table, options.out)
    elif options.command == "correct-trend":
        sinks.restate_trend(spark, options.path, METRICS["sales_trend"])
    elif options.command == "compact-totals":
        sinks.compact_totals(spark, options.path, options.out)
    elif options.command == "create-table":
        sinks.create_orders_table(spark, options.name, options.table)
    else:
        topic = _topic(options.results, results=True)
        messages = topic.replay(spark)
        if not isinstance(topic, FolderTopic):  # a broker keeps what was sent twice
            messages = readside.unrepeated(messages)
        write_csv(readside.flat_results(readside.all_result_rows(messages)), options.out)


def _stream(spark: SparkSession, options: argparse.Namespace) -> None:
    run = jobs.Run(
        options.checkpoint, jobs.LIVE if options.live else jobs.DRAIN,
        options.limit, options.partitions)
    if options.exact_money:
        run = replace(run, money=EXACT_MONEY)
    if options.command == "sketch":
        results = _topic(options.results, True, options.starting, options.source_option)
        queries = [jobs.start_sketches(spark, results, options.path, run)]
    elif options.command == "feed":
        results = _topic(options.results, True, options.starting, options.source_option)
        queries = [jobs.start_feed(spark, results, options.path, run, RESULT_SCHEMA,
                                   repeats_within=options.repeats_within)]
    else:
        orders = _topic(options.orders, False, options.starting, options.source_option)
        if options.command == "metrics":
            start = jobs.start_metrics if options.per_metric else jobs.start_metrics_one_pass
            results = _topic(options.results, True, options.starting, options.source_option)
            queries = start(spark, orders, results, run)
        elif options.command == "changes":
            queries = [jobs.start_metric_changes(spark, orders, options.path, run)]
        elif options.command == "store":
            queries = [jobs.start_upsert(spark, orders, options.table, run, options.key)]
        elif options.command == "best":
            queries = [jobs.start_best(spark, orders, f"{options.path}/{name}", run, name)
                       for name, metric in METRICS.items() if metric.top_by]
        elif options.command == "trend":
            queries = [jobs.start_trend(spark, orders, options.path, run, options.lateness)]
        elif options.command == "check":
            queries = [jobs.start_checked(spark, orders, options.path, run)]
        else:
            land = jobs.start_variant_landing if options.variant else jobs.start_landing
            queries = [land(spark, orders, options.path, run)]
    # Folders of totals, whose readers take those of the run that has caught up.
    totals = []
    if options.command == "changes":
        totals = [options.path]
    elif options.command == "best":
        totals = [f"{options.path}/{query.name}/totals" for query in queries]
    if options.live:
        jobs.run_until_any_ends(spark, queries, totals)
        return
    jobs.finish(queries)
    for query, path in zip(queries, totals):
        jobs.finish_changes(spark, query, path)


if __name__ == "__main__":
    main()
