"""Raw sales and product files to complete, flat order rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.functions.fields import column, missing_to_null, read_as, whole_number
from tillstream.schema import order_schema

# Header of a saved row index, as written by the usual tools or as Spark names a blank header.
_INDEX_COLUMN = re.compile(r"^(Unnamed: .*|_c\d+)$")


def _complete_rows(raw: DataFrame) -> DataFrame:
    kept = [name for name in raw.columns if not _INDEX_COLUMN.match(name)]
    rows = raw.select(*[missing_to_null(column(name)).alias(name) for name in kept])
    return rows.where(reduce(and_, [column(name).isNotNull() for name in kept]))


def _join_value(key: Column) -> Column:
    """Numbers meet by value ("5", "05" and "5.0" are one key), other texts as they are."""
    return F.coalesce(whole_number(key, T.LongType()).cast("string"), key)


def prepare(
    sales: DataFrame, products: DataFrame, key: str = "product_id",
    read: Callable[..., DataFrame] | None = None,
) -> DataFrame:
    """Sales rows with their product, without index columns and without incomplete rows.

    Both inputs hold text only. Rows are completed before the join, which gives the same
    result as after it (the join is inner) and sends less through the shuffle. Columns found
    on both sides besides the key get the suffixes _x and _y.

    `read` (`with_types`, or a part of it) reads the cells of both sides before the join rather
    than after it: the rows are the same, but numbers take less room to move than their texts.
    """
    left, right = _sides(sales, products, key)
    if read:
        left, right = read(left, keep=("__key",)), read(right, keep=("__key",))
    return left.join(right, "__key", "inner").drop("__key")


def prepare_streams(
    sales: DataFrame, products: DataFrame, wait: str, key: str = "product_id"
) -> DataFrame:
    """`prepare` on two streams. Products stay in the state, as a later sale may name them;
    a sale stays there until its product has come, but no longer than `wait` (None came: it is
    left out, like a sale without a product in `prepare`).

    Both clocks are the time of reading, which never goes back, so no row is late.

    A sale moves and waits as one text: a row of many short ones takes twice the room."""
    left, right = _sides(sales, products, key)
    cells = [name for name in left.columns if name != "__key"]
    left = left.select(
        "__key", F.to_json(F.array(*[column(name) for name in cells])).alias("__sale"))
    left = left.withColumn("__read", F.current_timestamp()).withWatermark("__read", "0 seconds")
    right = right.withColumnRenamed("__key", "__product").withColumn(
        "__came", F.current_timestamp()).withWatermark("__came", "0 seconds")
    met = (F.col("__key") == F.col("__product")) & (
        F.col("__came") <= F.col("__read") + F.expr(f"INTERVAL {wait}"))
    joined = left.join(right, met, "inner").drop("__key", "__product", "__read", "__came")
    sale = F.coalesce(F.from_json("__sale", "array<string>"), F.raise_error(F.lit(
        "a waiting sale is no list of cells: the checkpoint is of another version")))
    return joined.withColumn("__sale", sale).select(
        *[F.col("__sale")[place].alias(name) for place, name in enumerate(cells)],
        *[column(name) for name in joined.columns if name != "__sale"])


def _sides(sales: DataFrame, products: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Complete rows of both inputs, with what they meet by in `__key`."""
    left = _complete_rows(sales)
    right = _complete_rows(products)
    shared = (set(left.columns) & set(right.columns)) - {key}
    left = left.select(
        _join_value(column(key)).alias("__key"),
        *[column(c).alias(c + "_x" if c in shared else c) for c in left.columns],
    )
    right = right.select(
        _join_value(column(key)).alias("__key"),
        *[column(c).alias(c + "_y" if c in shared else c) for c in right.columns if c != key],
    )
    return left, right


def with_types(
    rows: DataFrame, money: T.DataType | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """The order-line fields among the columns to their types, and the `keep` columns as they
    are."""
    fields = [f for f in order_schema(money) if f.name in rows.columns]
    return rows.select(
        *[read_as(F.col(f.name), f.dataType).alias(f.name) for f in fields], *keep
    )
