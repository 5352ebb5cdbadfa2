"""How often rows are written and moved on the way from the tables to the jobs."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillstream.operators import keyed
from tillstream.plans import registry, staging
from tillstream.schema import FIELD_NAMES
from tillstream.sources import csv_files, star
from tillstream.streaming import sinks

SF = "/root/testdata/sf0.001"


def plan(table):
    return table._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def own_sf(tmp_path):
    """The tables under a path of their own, for which nothing is made yet."""
    folder = tmp_path / "sf"
    folder.mkdir()
    for table in Path(SF).iterdir():
        os.symlink(table, folder / table.name)
    return str(folder)


def made(sf_dir):
    return {name: path for (_, at, name), path in staging._made.items() if at == sf_dir}


def test_jobs_read_the_deliveries_where_they_lie(spark, own_sf):
    first, both = staging._deliveries(spark, own_sf)
    early, files = set(first.replay(spark).inputFiles()), both.replay(spark).inputFiles()
    assert early < set(files) and len(files) == len(set(files))
    lines = spark.read.parquet(f"{own_sf}/lineitem.parquet")
    assert both.replay(spark).count() == lines.count()
    ends = lines.agg(F.min("l_orderkey") + F.max("l_orderkey")).first()[0]
    assert first.replay(spark).count() == lines.where(2 * F.col("l_orderkey") < ends).count()
    staging.changed_totals(spark, own_sf)
    assert not os.path.exists(f"{made(own_sf)['changes_job']}/orders")


def test_orders_join_the_lines_last(spark):
    text = star.order_lines(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    last = next(line for line in text.splitlines() if "Join" in line)
    assert "l_orderkey" in last and "c_custkey" not in last


def test_lines_move_before_they_take_up_texts(spark):
    """Lookups that are broadcast are joined where the lines were moved to."""
    text = plan(star.order_lines(spark, SF))
    assert text.count("Exchange hashpartitioning(l_orderkey") == 1
    moved = text[text.index("Exchange hashpartitioning(l_orderkey"):]
    assert "Join" not in moved[:moved.index("ReadSchema")] and "l_suppkey" in moved


@pytest.mark.parametrize("limit, order", [
    (-1, ["l_orderkey", "l_suppkey", "l_partkey"]), (None, ["l_orderkey", "l_partkey", "l_suppkey"])])
def test_lookups_that_shuffle_come_before_broadcast_ones(spark, limit, order):
    """Products alone too large to broadcast join the lines before these have their supplier's
    name; where suppliers are too, that one name comes before all the products have."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "1" if limit is None else str(
        os.path.getsize(f"{SF}/part.parquet") + limit))
    try:
        lines = star.order_lines(spark, SF)
        text = lines._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(name, before)
    joins = [row for row in text.splitlines() if "Join" in row]
    assert [key for row in joins for key in order if key in row] == order
    assert "Repartition" not in text  # products move the lines anyway


def test_products_need_no_sales(spark, own_sf):
    assert registry.publish_csv_rows(spark, own_sf).count() == 200
    assert set(made(own_sf)) == {"raw_products"}


def test_keyed_rows_move_once(spark, tmp_path):
    lines = star.order_lines(spark, SF).localCheckpoint().repartition(3, "order_id")
    assert plan(keyed.upsert(lines)).count("Exchange hashpartitioning") == 1
    table = keyed.upsert(lines).withColumns({
        "position": F.lit(1), "bucket": sinks.bucket_of(F.col("row_key"))})
    table.write.parquet(str(tmp_path / "table"))
    stored = spark.read.parquet(str(tmp_path / "table"))
    dealt = sinks.latest_orders(stored.repartition(16, "row_key"), list(FIELD_NAMES))
    assert plan(dealt.repartition(16, "row_key")).count("Exchange hashpartitioning") == 1
    order = ["bucket", "row_key"]
    ranged = sinks.latest_orders(stored.repartitionByRange(*order), list(FIELD_NAMES), order)
    assert plan(ranged).count("Exchange") == 1
    assert ranged.columns == stored.columns and ranged.exceptAll(stored).isEmpty()


def test_an_upsert_batch_moves_rows_once(spark, tmp_path):
    lines = star.order_lines(spark, SF).select(
        *[F.col(n).cast("string").alias(n) for n in FIELD_NAMES], F.lit(1).alias("position"))
    sinks.upsert_sink(str(tmp_path / "log"))(lines.coalesce(2), 0)
    stored = spark.read.parquet(str(tmp_path / "log"))
    assert stored.count() == stored.select("row_key").distinct().count()
    assert stored.inputFiles()[0].endswith(".zstd.parquet")


def test_cells_are_read_before_they_move(spark, own_sf):
    text = registry.prep_sales(spark, own_sf)._jdf.queryExecution().optimizedPlan().toString()
    above, below = text.split("Join Inner")
    assert "as decimal(18,4)" in below and "as decimal(18,4)" not in above


def test_raw_files_are_packed_in_parts_of_a_task(spark, own_sf, monkeypatch):
    monkeypatch.setitem(csv_files._PACKED, "maxRecordsPerFile", "2500")
    files = list(Path(staging.raw_sales(spark, own_sf).removeprefix("file:")).glob("part-*"))
    assert len(files) >= 3 and all(file.name.endswith(".csv.gz") for file in files)
    lines = spark.read.parquet(f"{own_sf}/lineitem.parquet").count()
    found = [csv_files.read_csv(spark, str(file)).count() for file in files]
    assert sum(found) == lines and max(found) <= 2500
