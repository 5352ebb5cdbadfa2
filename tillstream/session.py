"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: joins turn to broadcast only by measured size, hot join
    # partitions are split, small ones are merged.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # State of the per-customer and per-window aggregates grows with the data, so it lives
    # in RocksDB rather than on the executor heap; only changes are uploaded per batch.
    STATE_PROVIDER:
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    CHANGELOG: "true",
}

# State that holds whole rows, packed closely: both the files beside the tasks and what is kept of
# them in the checkpoint.
CLOSE_STATE = {
    STATE_PROVIDER: SETTINGS[STATE_PROVIDER],
    CHANGELOG: SETTINGS[CHANGELOG],
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "32",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
}

# Shuffle files go when the query that made them ends, not when the driver happens to collect garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_roots: dict[str, str] = {}


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the jobs are designed for; `settings` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{package.name}-package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder path that every executor can reach.

    The root is `spark.checkpoint.dir`. Only where driver and executors are one process (a
    master `local` or `local[...]`) and nothing is set, as in tests, it is a folder of this
    machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="run-")
        root = _local_roots[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
