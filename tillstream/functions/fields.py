"""Column expressions for reading loosely typed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.schema import DATE_FORMAT, MISSING_TOKENS


def column(name: str) -> Column:
    """The column of that very name, which may contain dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing_to_null(text: Column) -> Column:
    """NULL for the texts that mean "no value"; any other text unchanged."""
    return F.when(~text.isin(*MISSING_TOKENS), text)


def whole_number(text: Column, to: T.DataType) -> Column:
    """Integer from text. "5.0" counts as 5: a column with gaps is often saved that way."""
    return F.coalesce(
        text.try_cast(to),
        F.regexp_replace(text, r"\.0+$", "").try_cast(to),
    )


def read_as(text: Column, to: T.DataType) -> Column:
    """Text to the wanted type; NULL, never an error, where the text does not fit."""
    if isinstance(to, T.StringType):
        return text
    if isinstance(to, T.IntegralType):
        return whole_number(text, to)
    return text.try_cast(to)


def event_time(text: Column, accept_date_only: bool = False) -> Column:
    """Event time of a date text; NULL where it does not match the format."""
    time = F.try_to_timestamp(text, F.lit(DATE_FORMAT))
    if accept_date_only:
        time = F.coalesce(time, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return time


def metric_label(text: Column) -> Column:
    """One spelling per metric: lower case, underscores for spaces."""
    return F.replace(F.lower(text), F.lit(" "), F.lit("_"))
