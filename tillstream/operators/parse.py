"""Messages to order lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.functions.fields import event_time, read_as
from tillstream.operators.prepare import with_types
from tillstream.schema import FIELD_NAMES, WIRE_SCHEMA, order_schema, strict_schema


def _from_value(
    messages: DataFrame, schema: T.StructType, keep: Sequence[str], malformed: str | None = None
) -> DataFrame:
    options = {}
    if malformed:
        schema = T.StructType([*schema.fields, T.StructField(malformed, T.StringType())])
        options["columnNameOfCorruptRecord"] = malformed
    return (
        messages.select(F.col("value").cast("string").alias("json_str"), *keep)
        .select(F.from_json("json_str", schema, options).alias("data"), *keep)
        .select("data.*", *keep)
    )


def wire_lines(
    messages: DataFrame, keep: Sequence[str] = (), fields: Sequence[str] = FIELD_NAMES,
    malformed: str | None = None,
) -> DataFrame:
    """The asked fields as text, just as they were sent. `keep` names message columns to keep;
    `malformed` a column for the text of messages that are no JSON object."""
    schema = T.StructType([WIRE_SCHEMA[name] for name in fields])
    return _from_value(messages, schema, keep, malformed)


def unread_numbers(fields: Sequence[str], money: T.DataType | None = None) -> dict[str, Column]:
    """For every number among the fields of `wire_lines`: is it set but not readable as one? A
    price that does not fit a decimal `money` type counts as unreadable."""
    typed = order_schema(money)
    return {
        name: F.col(name).isNotNull() & read_as(F.col(name), typed[name].dataType).isNull()
        for name in fields if not isinstance(typed[name].dataType, T.StringType)
    }


# How a variant names its numbers.
_WHOLE, _FRACTIONS = ("BIGINT",), ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def _strict_lines(messages: DataFrame, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Numbers only where JSON has a number. The JSON reader takes every number field as a
    variant, whatever it is, so that quoted numbers raise no errors; one look at its kind tells
    whether it is read any further."""
    typed = strict_schema()
    layout = T.StructType([
        typed[name] if isinstance(typed[name].dataType, T.StringType)
        else T.StructField(name, T.VariantType()) for name in fields])
    body = messages.select(
        F.from_json(F.col("value").cast("string"), layout).alias("data"), *keep
    ).select("data.*", *keep)

    def read(name: str) -> Column:
        to = typed[name].dataType
        if isinstance(to, T.StringType):
            return F.col(name)
        kind = F.schema_of_variant(name)
        kinds = _WHOLE if isinstance(to, T.IntegralType) else _FRACTIONS
        number = reduce(or_, [F.startswith(kind, F.lit(k)) for k in kinds])
        return F.when(number, F.try_variant_get(name, "$", to.simpleString())).alias(name)

    return body.select(*[read(name) for name in fields], *keep)


def parse_orders(
    messages: DataFrame,
    money: T.DataType | None = None,
    strict: bool = False,
    accept_date_only: bool = False,
    keep: Sequence[str] = (),
    fields: Sequence[str] = FIELD_NAMES,
    malformed: str | None = None,
) -> DataFrame:
    """Typed order lines plus, if `date_` is among the fields, `timestamp`, the event time.

    The sender quotes every value, so numbers are read from text; `strict` instead wants JSON
    numbers and gives NULL for quoted ones. A message that is no JSON becomes a row of NULLs.
    Works on tables and streams. Ask for the fields that are needed: the planner keeps the
    JSON parser from reading the others only where a single one is used.
    """
    if strict:
        lines = _strict_lines(messages, fields, keep)
    else:
        wire = wire_lines(messages, keep, fields, malformed)
        lines = with_types(wire, money, [*keep, malformed] if malformed else keep)
    if "date_" not in fields:
        return lines
    return lines.withColumn("timestamp", event_time(F.col("date_"), accept_date_only))


def as_variants(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Messages as `document`, a variant of all their fields, and `raw`, the text of those that
    are no JSON object (`document` is NULL for them)."""
    text = F.col("value").cast("string")
    parsed = messages.select(text.alias("raw"), F.try_parse_json(text).alias("document"), *keep)
    is_object = F.coalesce(F.startswith(
        F.schema_of_variant("document"), F.lit("OBJECT")), F.lit(False))
    return parsed.select(
        F.when(is_object, F.col("document")).alias("document"),
        F.when(~is_object, F.col("raw")).alias("raw"), *keep)


def variant_lines(
    documents: DataFrame, money: T.DataType | None = None, fields: Sequence[str] = FIELD_NAMES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Typed order lines like those of `parse_orders`, read by path from stored variants: no
    text is parsed, and fields that are not asked for are passed over."""
    wire = documents.select(*[
        F.try_variant_get("document", f"$.{name}", "string").alias(name) for name in fields], *keep)
    lines = with_types(wire, money, keep)
    if "date_" not in fields:
        return lines
    return lines.withColumn("timestamp", event_time(F.col("date_")))


def malformed_messages(messages: DataFrame) -> DataFrame:
    """Quarantine: the messages that are no JSON object, with their text in `malformed`."""
    marked = T.StructType(WIRE_SCHEMA.fields + [T.StructField("_malformed", T.StringType())])
    text = F.col("value").cast("string")
    parsed = F.from_json(text, marked, {"columnNameOfCorruptRecord": "_malformed"})
    return (
        messages.withColumn("malformed", parsed["_malformed"])
        .where(F.col("malformed").isNotNull())
    )
