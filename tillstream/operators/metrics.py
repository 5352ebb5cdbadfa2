"""The nine order metrics.

A metric is a plain function from order lines to a small table, so it runs unchanged on a
table and on a stream. All of them aggregate with partial results per task before the
shuffle: a brand or city that holds a third of all lines sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.schema import TOP_N, TREND_MINUTES, order_schema


@dataclass(frozen=True)
class Measure:
    """One output column: how (sum, money, count or mean) and over which field."""

    name: str
    how: str
    field: str

    def column(self) -> Column:
        if self.how == "sum":
            result = F.sum(self.field)
        elif self.how == "money":
            result = F.sum(self.field).cast("double")
        elif self.how == "count":
            result = F.count(self.field)
        else:
            result = F.try_divide(F.sum(self.field).cast("double"), F.count(self.field))
        return result.alias(self.name)


@dataclass(frozen=True)
class Metric:
    name: str
    key: str
    measures: tuple[Measure, ...]
    top_by: str | None = None  # keep the TOP_N keys with the highest value of this measure
    ratio: tuple[str, str, str] | None = None  # (output, dividend, divisor)
    per_window: bool = False

    @property
    def key_set(self) -> str:
        """Name of the kind of key the metric is grouped by."""
        return f"{self.key}_by_window" if self.per_window else self.key

    @property
    def fields(self) -> tuple[str, ...]:
        """Order-line fields the metric reads."""
        read = [self.key, *[m.field for m in self.measures]]
        return tuple(dict.fromkeys(read + (["date_"] if self.per_window else [])))

    @property
    def outputs(self) -> tuple[str, ...]:
        names = (["window"] if self.per_window else []) + [self.key]
        names += [m.name for m in self.measures]
        return tuple(names + ([self.ratio[0]] if self.ratio else []))

    def compute(self, lines: DataFrame) -> DataFrame:
        """The metric over `lines`. NULL keys form a group of their own."""
        return self.finish(self.totals(lines))

    def totals(self, lines: DataFrame) -> DataFrame:
        """The measures per key, without ratio and top list."""
        keys = [F.window("timestamp", f"{TREND_MINUTES} minutes")] if self.per_window else []
        return lines.groupBy(*keys, self.key).agg(*[m.column() for m in self.measures])

    def finish(self, totals: DataFrame) -> DataFrame:
        """Ratio and top list, from one row per key."""
        if self.ratio:
            output, dividend, divisor = self.ratio
            totals = totals.withColumn(output, F.try_divide(dividend, divisor))
        if self.top_by:
            # The key breaks ties, so the cut does not depend on task order.
            totals = totals.orderBy(F.desc(self.top_by), F.asc(self.key)).limit(TOP_N)
        return totals.select(*self.outputs)


# Names, keys, measures and output columns of the metrics.
METRICS = {
    metric.name: metric
    for metric in (
        Metric("sales_by_category", "l1_category",
               (Measure("total_sales", "money", "unit_selling_price"),)),
        Metric("quantity_by_city", "city_name",
               (Measure("total_procured_quantity", "sum", "procured_quantity"),)),
        Metric("top_brands", "brand_name",
               (Measure("brand_count", "count", "brand_name"),), top_by="brand_count"),
        Metric("sales_trend", "l1_category",
               (Measure("sales", "money", "unit_selling_price"),), per_window=True),
        Metric("avg_price_by_category", "l1_category",
               (Measure("avg_unit_selling_price", "mean", "unit_selling_price"),)),
        Metric("discount_by_brand", "brand_name",
               (Measure("total_discount_amount", "money", "total_discount_amount"),)),
        Metric("orders_by_city", "city_name",
               (Measure("total_orders", "count", "order_id"),)),
        Metric("top_products", "product_name",
               (Measure("total_quantity_sold", "sum", "procured_quantity"),),
               top_by="total_quantity_sold"),
        Metric("aov_by_customer", "dim_customer_key",
               (Measure("total_spent", "money", "unit_selling_price"),
                Measure("order_count", "count", "order_id")),
               ratio=("average_order_value", "total_spent", "order_count")),
    )
}

ALL = tuple(METRICS.values())

# The totals a measure is made of, each a sum or a count of its field.
_TOTALS_OF = {"money": ("sum",), "sum": ("sum",), "count": ("count",), "mean": ("sum", "count")}


def _totals(metric: Metric) -> list[tuple[str, str]]:
    """(kind, field) of every total the metric needs."""
    return list(dict.fromkeys(
        (kind, measure.field) for measure in metric.measures for kind in _TOTALS_OF[measure.how]))


def fields_of(wanted: Sequence[Metric] = ALL) -> tuple[str, ...]:
    """Order-line fields the metrics read."""
    return tuple(dict.fromkeys(field for metric in wanted for field in metric.fields))


def _window_start() -> Column:
    """Start of the trend window a line falls into; NULL without an event time. As a plain
    expression, since the window function drops lines without a time for all metrics."""
    length = TREND_MINUTES * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds("timestamp") / length) * length)


def compute_all(lines: DataFrame, wanted: Sequence[Metric] = ALL) -> DataFrame:
    """Totals for all wanted metrics from one pass over `lines`.

    A line becomes one row per kind of key, which stays within its task: the rows are added
    up there before the shuffle. `key_set` names the kind of key; its value is in `key`, as
    text, and for the trend in `window_start` too. There is one column per distinct total
    (`sum_<field>`, `count_<field>`), with the field's own type; a kind of key leaves those
    it does not need empty.
    """
    types = {f.name: f.dataType for f in lines.schema}
    absent = sorted({field for m in wanted for _, field in _totals(m)} - set(types))
    if absent:
        raise ValueError(f"missing fields: {', '.join(absent)}")
    totals = list(dict.fromkeys(total for metric in wanted for total in _totals(metric)))
    no_window = F.lit(None).cast("timestamp")

    def row(key_set: str) -> Column:
        mine = [metric for metric in wanted if metric.key_set == key_set]
        needed = {total for metric in mine for total in _totals(metric)}

        def amount(kind: str, field: str) -> Column:
            if kind == "count":
                value = F.col(field).isNotNull() if (kind, field) in needed else F.lit(False)
            else:
                value = F.col(field) if (kind, field) in needed else F.lit(None).cast(types[field])
            return value.alias(f"{kind}_{field}")

        return F.struct(
            F.lit(key_set).alias("key_set"),
            (_window_start() if mine[0].per_window else no_window).alias("window_start"),
            F.col(mine[0].key).cast("string").alias("key"),
            *[amount(*total) for total in totals],
        )

    key_sets = dict.fromkeys(metric.key_set for metric in wanted)
    windowed = [metric.key_set for metric in wanted if metric.per_window]
    rows = lines.select(F.inline(F.array(*[row(key_set) for key_set in key_sets])))
    rows = rows.where(~F.col("key_set").isin(windowed) | F.col("window_start").isNotNull())
    added = {"sum": F.sum, "count": F.count_if}
    return rows.groupBy("key_set", "window_start", "key").agg(
        *[added[kind](f"{kind}_{field}").alias(f"{kind}_{field}") for kind, field in totals])


def compute_all_once(
    lines: DataFrame, path: str, wanted: Sequence[Metric] = ALL
) -> dict[str, DataFrame]:
    """The wanted metrics of a table, their totals kept under `path`.

    Without the written totals every metric would push its own filter down to the scan and
    make a pass of its own. They hold one row per key value and are split by kind of key, so
    a metric reads only its part.
    """
    compute_all(lines, wanted).write.partitionBy("key_set").mode("overwrite").parquet(path)
    totals = lines.sparkSession.read.parquet(path)
    return {metric.name: pick(totals, metric) for metric in wanted}


def pick(totals: DataFrame, metric: Metric) -> DataFrame:
    """One metric out of the rows of `compute_all`."""
    def value(measure: Measure) -> Column:
        if measure.how == "count":
            return F.col(f"count_{measure.field}")
        total = F.col(f"sum_{measure.field}")
        if measure.how == "mean":
            return F.try_divide(total.cast("double"), F.col(f"count_{measure.field}"))
        return total.cast("double") if measure.how == "money" else total

    key_type = order_schema()[metric.key].dataType
    columns = [F.col("key").cast(key_type).alias(metric.key)]
    if metric.per_window:
        end = F.col("window_start") + F.expr(f"INTERVAL {TREND_MINUTES} MINUTES")
        columns.append(
            F.struct(F.col("window_start").alias("start"), end.alias("end")).alias("window"))
    mine = totals.where(F.col("key_set") == metric.key_set)
    return metric.finish(mine.select(
        *columns, *[value(m).alias(m.name) for m in metric.measures]))


def labelled(metric: Metric, rows: DataFrame) -> DataFrame:
    return rows.withColumn("metric", F.lit(metric.name))


def union_of(tables: list[DataFrame]) -> DataFrame:
    """Tables with different columns stacked into one; what a table lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def result_messages(
    rows_by_metric: dict[str, DataFrame], epoch_id: int, run_id: str = ""
) -> DataFrame:
    """Metric tables as JSON messages in `value`, next to metric, run_id and epoch_id. NULL
    fields are left out of the JSON. All messages of a snapshot have one publish time.

    A message's id is made of run, epoch, metric and the key of its row, not of its measures: sums
    of doubles may come out differently when a batch runs again, and are the same message."""
    messages = []
    for name, rows in rows_by_metric.items():
        metric = METRICS[name]
        keys = [F.col("window.start")] if metric.per_window else []
        body = labelled(metric, rows).withColumns({
            "run_id": F.lit(run_id), "epoch_id": F.lit(epoch_id).cast("long"),
            "published_at": F.current_timestamp(),
            "message_id": F.md5(F.to_json(F.struct(
                F.lit(run_id), F.lit(epoch_id), F.lit(name), *keys, metric.key)).cast("binary"))})
        messages.append(body.select(
            "metric", "run_id", "epoch_id", F.to_json(F.struct("*")).alias("value")))
    return union_of(messages)
