"""Jobs in a session without this package's settings, started from another folder."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.session.timeZone", "UTC").getOrCreate()
from tillstream.plans import registry
print("rows", registry.recent_state_stream(spark, "/root/testdata/sf0.001").count())
"""


def test_state_needs_neither_the_settings_nor_the_path_of_the_package(tmp_path):
    env = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=str(ROOT))], cwd=tmp_path, env=env,
        capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert int(done.stdout.split("rows")[1]) > 100


def test_preparation_keeps_its_state_on_disk(spark, tmp_path):
    from tillstream.session import STATE_PROVIDER
    from tillstream.streaming import jobs

    (tmp_path / "sales").mkdir()
    (tmp_path / "products").mkdir()
    (tmp_path / "sales/a.csv").write_text("order_id,product_id\n1,5\n")
    (tmp_path / "products/a.csv").write_text("product_id,product_name\n5,tea\n")
    before = spark.conf.get(STATE_PROVIDER)
    spark.conf.set(STATE_PROVIDER, before.replace("RocksDB", "HDFSBacked"))
    try:
        query = jobs.start_preparation(
            spark, str(tmp_path / "sales"), str(tmp_path / "products"), str(tmp_path / "rows"),
            jobs.Run(str(tmp_path / "cp"), jobs.DRAIN, partitions=2))
        jobs.finish([query])
    finally:
        spark.conf.set(STATE_PROVIDER, before)
    assert any(name.startswith("rocksdb") for name in
               query.recentProgress[0]["stateOperators"][0]["customMetrics"])
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 1
