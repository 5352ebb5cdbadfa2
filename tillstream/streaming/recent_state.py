"""The last messages of every key as keyed state of a stream.

The state of a key is a list that holds its last messages and nothing else: a batch reads and
writes the lists of the keys its messages have, however many messages there were before. A key
is dealt to slices by a hash of its messages, each with a list of its own, so a key that holds a
third of all messages keeps several tasks busy; reading puts the slices together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tillstream.operators import recent

SLICES = 8

# The processor is sent whole, not by its module's name: Spark also loads it in a worker beside the
# driver, which gets no files of the application and need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class LastMessages(StatefulProcessor):
    """The last `size` messages of a key and slice, as (order columns, body)."""

    def __init__(self, order: Sequence[str], size: int, expire_ms: int | None):
        self.order, self.size, self.expire_ms = list(order), size, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        layout = ", ".join([*[f"{name} long" for name in self.order], "body string"])
        self.kept = handle.getListState("kept", layout, self.expire_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = [*self.order, "body"]
        kept = pd.DataFrame([tuple(row) for row in self.kept.get()], columns=columns)
        for part in rows:
            both = pd.concat([kept, part[columns]]) if len(kept) else part[columns]
            # The body breaks ties, so the cut does not depend on the order of tasks.
            kept = both.sort_values(columns, ascending=False).head(self.size)
        self.kept.put([(*map(int, row[:-1]), row[-1]) for row in kept.itertuples(
            index=False, name=None)])
        metric, piece = key
        yield kept.assign(key=metric, slice=piece)[["key", "slice", *columns]]

    def close(self) -> None:
        pass


def _numbers(order: Sequence[str], rows: DataFrame) -> list[Column]:
    """What rows are ordered by, as whole numbers: numbers, times, or structs of these."""
    found = []

    def add(value: Column, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for field in kind:
                add(value[field.name], field.dataType)
        else:
            whole = F.unix_micros(value) if isinstance(kind, T.TimestampType) else value
            found.append(F.coalesce(whole.cast("long"), F.lit(-(1 << 63))))

    for name in order:
        add(F.col(name), rows.schema[name].dataType)
    return found


def last_messages(
    rows: DataFrame, key: str, order: Sequence[str], size: int = recent.BUFFER_SIZE,
    expire_ms: int | None = None,
) -> DataFrame:
    """(key, slice, o0, o1, ..., body) on a stream, in append mode: after each batch the whole
    lists of the keys and slices that it changed. `body` is the row as JSON. A list that got no
    message for `expire_ms` leaves the state."""
    numbers = _numbers(order, rows)
    names = [f"o{i}" for i in range(len(numbers))]
    marked = rows.select(
        F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("body"),
        *[number.alias(name) for number, name in zip(numbers, names)])
    sliced = marked.withColumn("slice", F.pmod(F.xxhash64("body"), F.lit(SLICES)).cast("int"))
    layout = ", ".join(["key string, slice int", *[f"{n} long" for n in names], "body string"])
    return sliced.groupBy("key", "slice").transformWithStateInPandas(
        LastMessages(names, size, expire_ms), layout, "Append",
        "ProcessingTime" if expire_ms else "None")


def stored_last_messages(
    spark: SparkSession, path: str, schema: T.StructType, size: int = recent.BUFFER_SIZE
) -> DataFrame:
    """The last messages per key as they stand, from the batches that `rows_sink` stored.

    Every run has a newest list per key and slice. The last messages are among those of all
    runs, so a run that reads the topic anew takes nothing away while it catches up."""
    stored = spark.read.parquet(path)
    last = stored.groupBy("run_id", "key", "slice").agg(F.max("batch_id").alias("batch_id"))
    names = [name for name in stored.columns if name.startswith("o") and name[1:].isdigit()]
    lists = stored.join(last, ["run_id", "key", "slice", "batch_id"], "left_semi")
    each = lists.select("key", *names, "body").distinct()
    kept = recent.last_per_key(each, "key", [*names, "body"], size)
    return kept.select(F.from_json("body", schema).alias("row")).select("row.*")
