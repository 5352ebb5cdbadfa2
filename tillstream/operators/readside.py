"""Reading the result log: replay, snapshots and the aggregates the dashboards show.

The log holds every snapshot of every metric. `latest` reads the newest snapshot and is what
one normally wants. `cumulative` takes all snapshots together, so sums grow with the number
of epochs; it exists because the dashboards this replaces work that way.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.functions.fields import metric_label
from tillstream.operators import keyed
from tillstream.schema import ENVELOPE, RESULT_SCHEMA, TOP_N, TOPIC_SCHEMA
from tillstream.sources.topics import ARRIVAL

HISTOGRAM_BINS = 20  # fixed value


def result_rows(messages: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """Messages of mixed metrics as one table with every field the jobs' messages carry, or
    with the asked fields besides the envelope.

    Where the log is split into folders by metric, run and epoch, those columns come from the
    folder names, so filters on them skip the other folders.
    """
    wanted = dict.fromkeys([*ENVELOPE, *(fields or RESULT_SCHEMA.names)])
    known = T.StructType([RESULT_SCHEMA[name] for name in wanted])
    return _fields_of(messages, known)


def all_result_rows(messages: DataFrame) -> DataFrame:
    """Messages as one table with every field that any message carries, known or not.

    One pass over the messages finds their fields and types; fields of the jobs keep theirs.
    """
    body = F.try_parse_json(F.col("value").cast("string"))
    found = messages.agg(F.schema_of_variant_agg(body)).first()[0] or ""
    carried = _struct_of(found)
    extra = [f for f in carried if f.name not in RESULT_SCHEMA.names]
    return _fields_of(messages, T.StructType(RESULT_SCHEMA.fields + extra))


def _struct_of(variant_schema: str) -> T.StructType:
    """The fields of a variant's schema; mixed and always empty ones are text."""
    if not variant_schema.startswith("OBJECT<") or variant_schema == "OBJECT<>":
        return T.StructType()
    ddl = re.sub(r"\b(VARIANT|VOID)\b(?=[,>])", "STRING", variant_schema)
    return T.DataType.fromDDL(ddl.replace("OBJECT<", "STRUCT<"))


def _fields_of(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of the messages' bodies, but for those that a split log has as folders. The
    topic's own columns are not fields: a message may have a field named like one."""
    folders = set(messages.columns) - set(TOPIC_SCHEMA.names)
    in_body = [f for f in schema if f.name not in folders]
    body = F.from_json(F.col("value").cast("string"), T.StructType(in_body))
    rows = messages.withColumn("__data", body) if in_body else messages
    return rows.select(*[
        F.col(f.name) if f.name in folders else F.col("__data").getField(f.name).alias(f.name)
        for f in schema
    ]).withColumn("metric", metric_label(F.col("metric")))


def identity() -> Column:
    """What tells a message of a topic from all others, however often it is there.

    That is the id its sender gave it; else, if a run and an epoch are named, these and all other
    fields but the publish time, whatever they are and in any order. A message without them
    belongs to no batch that could run twice, so its place in the topic tells it.
    """
    text = F.col("value").cast("string")
    fields = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    told = F.sort_array(F.map_entries(F.map_filter(fields, lambda k, _: k != "published_at")))
    in_batch = fields["run_id"].isNotNull() & fields["epoch_id"].isNotNull()
    return F.coalesce(
        F.concat(F.lit("id "), fields["message_id"]),
        F.when(in_batch, F.concat(F.lit("body "), F.sha2(F.to_json(told), 256))),
        F.concat_ws(" ", F.lit("at"), *[F.col(name).cast("string") for name in ARRIVAL]))


def unrepeated(messages: DataFrame) -> DataFrame:
    """The messages of an append-only log, in which a batch that ran twice left its messages
    twice: of each the one that came last. Nothing is assumed about their fields."""
    marked = messages.withColumn("__identity", identity()).withColumn(
        "__position", F.struct(*ARRIVAL))
    last = keyed.latest_per_key(marked, ["__identity"], ["__position"])
    return last.select(*messages.columns)


def without_repeats(messages: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """`result_rows` of an append-only log."""
    return result_rows(unrepeated(messages), fields)


def feed_rows(messages: DataFrame, schema: T.StructType = RESULT_SCHEMA) -> DataFrame:
    """Messages by the JSON fields of `schema`, plus their place in the topic."""
    return messages.select(
        F.from_json(F.col("value").cast("string"), schema).alias("data"),
        F.struct(*ARRIVAL).alias("position"),
    ).select("data.*", "position")


def is_error() -> Column:
    return F.col("error").isNotNull()


def has_metric() -> Column:
    return F.col("metric").isNotNull() & (F.col("metric") != "")


Snapshots = dict[str, tuple[str, int]]  # run and epoch of every metric's newest snapshot


def of_metric(
    rows: DataFrame, metric: str, mode: str = "latest", newest: Snapshots | None = None
) -> DataFrame:
    """Rows of one metric: of its newest snapshot, or of all.

    `newest` tells the snapshot by value, so that only its folder is opened. Without it the
    snapshot that was published last is looked for in the log, which reads all of the metric.
    """
    mine = rows.where(F.col("metric") == metric)
    if mode == "cumulative":
        return mine
    if mode != "latest":
        raise ValueError(f"mode is latest or cumulative, not {mode!r}")
    if newest is not None:
        return mine.where(_is_snapshot(newest[metric]) if metric in newest else F.lit(False))
    last = mine.agg(F.max(F.struct("published_at", "epoch_id", "run_id"))).scalar()
    return mine.where((F.col("epoch_id") == last["epoch_id"]) & F.col("run_id").eqNullSafe(
        last["run_id"]))


def _is_snapshot(snapshot: tuple[str, int]) -> Column:
    run_id, epoch_id = snapshot
    return (F.col("run_id") == run_id) & (F.col("epoch_id") == epoch_id)


def is_newest(rows: DataFrame, newest: Snapshots) -> Column:
    """Does a row of the split log belong to the newest snapshot of its metric?"""
    wanted = [(F.col("metric") == name) & _is_snapshot(at) for name, at in newest.items()]
    return reduce(or_, wanted, F.lit(False))


def newest_of_all(rows: DataFrame, newest: Snapshots | None = None) -> DataFrame:
    """The newest snapshot of every metric: of those told by `newest`, only their folders are
    opened; otherwise one row per metric meets the whole log."""
    if newest is not None:
        return rows.where(is_newest(rows, newest))
    last = rows.groupBy("metric").agg(F.max(F.struct("published_at", "epoch_id", "run_id")).alias(
        "__last")).select(F.col("metric").alias("__metric"), "__last.epoch_id", "__last.run_id")
    last = last.withColumnsRenamed({"epoch_id": "__epoch", "run_id": "__run"})
    return rows.join(last, (F.col("metric") == F.col("__metric"))
                     & (F.col("epoch_id") == F.col("__epoch"))
                     & F.col("run_id").eqNullSafe(F.col("__run")), "left_semi")


def require(rows: DataFrame, *columns: str) -> None:
    """Refuse tables that lack a column."""
    absent = [name for name in columns if name not in rows.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")


def non_numeric(rows: DataFrame, measure: str) -> DataFrame:
    """How many values of a measure are set but no number."""
    bad = F.col(measure).isNotNull() & F.col(measure).try_cast("double").isNull()
    return rows.agg(F.count_if(bad).alias("non_numeric"))


def _numeric(rows: DataFrame, measure: str) -> Column:
    if isinstance(rows.schema[measure].dataType, T.NumericType):
        return F.col(measure)
    return F.col(measure).try_cast("double")


def total_per_key(rows: DataFrame, key: str, measure: str) -> DataFrame:
    """Sum of the measure per key; the number of rows if no row carries the measure.
    Rows without a key are left out; a key with no values sums to 0."""
    require(rows, key)
    keyed_rows = rows.where(F.col(key).isNotNull()).groupBy(key)
    if measure not in rows.columns:
        return keyed_rows.agg(F.count("*").alias(measure))
    carried = rows.agg(F.count(measure)).scalar()
    total = F.coalesce(F.sum(_numeric(rows, measure)), F.lit(0))
    return keyed_rows.agg(total.alias("__total"), F.count("*").alias("__rows")).select(
        key, F.when(carried == 0, F.col("__rows")).otherwise(F.col("__total")).alias(measure))


def top(rows: DataFrame, key: str, measure: str, size: int = TOP_N) -> DataFrame:
    return rows.orderBy(F.desc(measure), F.asc(key)).limit(size)


def message_counts(rows: DataFrame, key: str) -> DataFrame:
    """How many messages name each key."""
    require(rows, key)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count"))


def mean_per_key(rows: DataFrame, key: str, measure: str) -> DataFrame:
    require(rows, key, measure)
    keyed = rows.where(F.col(key).isNotNull()).groupBy(key)
    return keyed.agg(F.avg(_numeric(rows, measure)).alias(measure))


def share_of_total(totals: DataFrame, measure: str) -> DataFrame:
    """Each row's part of the whole. The whole is a scalar subquery: a window over all rows
    would move them into one task."""
    whole = totals.agg(F.sum(measure)).scalar()
    return totals.withColumn("share", F.try_divide(F.col(measure), whole))


def histogram(rows: DataFrame, measure: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in `bins` bins of equal width between the smallest and the largest value; one
    bin if they are the same. Bins nothing falls into have no row."""
    values = rows.where(F.col(measure).isNotNull())
    ends = values.agg(F.struct(F.min(measure).alias("low"), F.max(measure).alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    width = (high - low) / F.lit(bins)
    number = F.when(high == low, F.lit(1)).otherwise(
        F.least(F.lit(bins), F.floor(F.try_divide(F.col(measure) - low, width)) + 1)
    )
    return (
        values.groupBy(number.cast("int").alias("bin"))
        .agg(F.count("*").alias("customers"))
        .withColumn("bin_start", low + (F.col("bin") - 1) * width)
        .withColumn("bin_end", F.when(high == low, high).otherwise(low + F.col("bin") * width))
    )


def metric_names(rows: DataFrame) -> DataFrame:
    """The metrics that have messages; a NULL stands for messages without one."""
    return rows.select("metric").distinct()


def messages_per_metric(rows: DataFrame) -> DataFrame:
    """Messages per metric, and in total in the row without a metric name."""
    return rows.rollup("metric").agg(
        F.grouping("metric").alias("is_total"), F.count("*").alias("messages")
    )


def flat_results(rows: DataFrame) -> DataFrame:
    """The result table without nested columns, ready for CSV."""
    plain = [
        F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, T.StructType)
    ]
    return rows.select(
        *plain, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")
    )
