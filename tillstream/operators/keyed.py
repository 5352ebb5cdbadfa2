"""The keyed order table: one row per order, fields grouped into families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.schema import FAMILIES, FIELD_NAMES, ORDER_FIELDS
from tillstream.sources.topics import exists


def has_key(key: str) -> Column:
    """Rows without a key, or with an empty one, have no place in the table. "0" is a key."""
    text = F.col(key).cast("string")
    return text.isNotNull() & (text != "")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The whole row with the highest `order` values for every key.

    An aggregate, not a window: each task first keeps its own latest row per key, so a key
    that holds a third of all rows sends one row per task to the shuffle.
    """
    rest = [name for name in rows.columns if name not in keys and name not in order]
    newest = F.max(F.struct(*order, *rest)).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(
        *[F.col(k) if k in keys else F.col(f"newest.{k}") for k in rows.columns]
    )


FAMILY_OF = {name: family for name, _, family in ORDER_FIELDS}


def to_families(lines: DataFrame, key: str = "order_id", *extra: str) -> DataFrame:
    """Row key plus one struct per family; all 21 fields, NULL where a field has no value.
    `extra` columns stay as they are."""
    structs = [
        F.struct(*[name for name, _, family in ORDER_FIELDS if family == wanted]).alias(wanted)
        for wanted in FAMILIES
    ]
    return lines.select(F.col(key).cast("string").alias("row_key"), *structs, *extra)


def family_fields() -> list[Column]:
    """The 21 fields of the keyed table, flat and in field order."""
    return [F.col(f"{family}.{name}").alias(name) for name, family in FAMILY_OF.items()]


def upsert(lines: DataFrame, key: str = "order_id", order: list[str] | None = None) -> DataFrame:
    """The keyed table that results from storing `lines` one after another.

    `order` says which line of an order comes last; by default the values of all fields,
    which is the same on every run."""
    order, wanted = order or list(FIELD_NAMES), lines.where(has_key(key))
    if isinstance(lines.schema[key].dataType, (T.IntegralType, T.StringType)):
        # By the key itself, so lines that lie by it already, after a join, stay where they are.
        others = [name for name in order if name != key]
        return to_families(latest_per_key(wanted, [key], others), key)
    marked = wanted.withColumn("row_key", F.col(key).cast("string"))
    return to_families(latest_per_key(marked, ["row_key"], order), key)


def _families_ddl() -> str:
    return ", ".join(
        f"{wanted} STRUCT<" + ", ".join(
            f"{field}: STRING" for field, _, family in ORDER_FIELDS if family == wanted
        ) + ">"
        for wanted in FAMILIES
    )


def create_lookup(spark: SparkSession, name: str, path: str, buckets: int) -> None:
    """Register `name(key)`, a table function that gives the current row of one key. The key's
    bucket follows from the key alone, so only that bucket's folders are opened; a filter on the
    table of `create_keyed_table` would read all of them."""
    names = ", ".join(FAMILIES)
    spark.sql(
        f"CREATE OR REPLACE FUNCTION {name}(wanted STRING) RETURNS TABLE(row_key STRING, "
        f"{_families_ddl()}) RETURN SELECT row_key, "
        + ", ".join(f"newest.{family}" for family in FAMILIES)
        + f" FROM (SELECT row_key, max(struct(position, {names})) AS newest FROM parquet.`{path}` "
        f"WHERE bucket = CAST(pmod(xxhash64(wanted), {buckets}) AS INT) AND row_key = wanted "
        "GROUP BY row_key)"
    )


def create_keyed_table(spark: SparkSession, name: str, path: str) -> None:
    """Register the keyed table over the folder the upsert job writes: a view with one current
    row per key, the one that came last in the topic. The folder is looked at anew whenever the
    view is read, so new batches are there at once; no effect if the view is there."""
    layout = (f"row_key STRING, {_families_ddl()}, position STRUCT<timestamp: TIMESTAMP, "
              "partition: INT, offset: BIGINT>, stored_at TIMESTAMP")
    # A table without rows gives an empty folder the layout of the log.
    empty = spark.createDataFrame([], layout).withColumns({
        "run_id": F.lit("none"), "batch_id": F.lit(0), "bucket": F.lit(0)})
    empty.write.mode("append").parquet(f"{path}/run_id=none/batch_id=0/bucket=0") if (
        not exists(spark, path)) else None
    names = ", ".join(FAMILIES)
    spark.sql(
        f"CREATE VIEW IF NOT EXISTS {name} AS SELECT row_key, newest.position, "
        + ", ".join(f"newest.{family}" for family in FAMILIES)
        + f" FROM (SELECT row_key, max(struct(position, {names})) AS newest "
        f"FROM parquet.`{path}` GROUP BY row_key)"
    )
