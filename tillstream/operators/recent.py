"""The most recent messages, per key and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: messages kept per metric and overall.
BUFFER_SIZE = 100

PLANNER_LIMIT = 1000  # the planner's own threshold
SLICES = 64


def last_per_key(
    rows: DataFrame, key: str, order: list[str], size: int = BUFFER_SIZE
) -> DataFrame:
    """The last `size` rows of every key.

    The bound on the row number lets every task cut each key to `size` rows before the
    shuffle, so a hot key does not pile up in one task. The planner does so for sizes up to
    spark.sql.optimizer.windowGroupLimitThreshold (1000). Beyond, every key is first cut in
    SLICES parts, dealt by a hash of the order columns, and then as a whole.
    """
    def cut(table: DataFrame, *keys: str) -> DataFrame:
        latest_first = Window.partitionBy(*keys).orderBy(*[F.desc(name) for name in order])
        ranked = table.withColumn("__rank", F.row_number().over(latest_first))
        return ranked.where(F.col("__rank") <= size).drop("__rank")

    if size > PLANNER_LIMIT:
        sliced = rows.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(SLICES)))
        rows = cut(sliced, key, "__slice").drop("__slice")
    return cut(rows, key)


def last_overall(rows: DataFrame, order: list[str], size: int = BUFFER_SIZE) -> DataFrame:
    """The last `size` rows, whatever their key."""
    return rows.orderBy(*[F.desc(name) for name in order]).limit(size)
