"""One pass that tells rows to keep from rows to refuse, each with all its reasons.

A reason is a short code: `not_json`, `no_key`, `unread:<field>` for a number that is set (a blank
is not) but cannot be read as one, `missing:<field>` for a cell without a value. Rows without a reason are
kept. Nothing is dropped: kept and rejected rows together are the rows that were read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.functions.fields import column, missing_to_null
from tillstream.operators.keyed import has_key
from tillstream.operators.parse import unread_numbers, wire_lines
from tillstream.schema import FIELD_NAMES

REASONS = "reasons"
KEPT, REJECTED = "kept", "rejected"


def _codes(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks]))


def judge_messages(
    messages: DataFrame, key: str | None = "order_id", fields: Sequence[str] = FIELD_NAMES,
    money: T.DataType | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """The asked fields as text, `raw`, the message itself, and `reasons`. A message that is no
    JSON object has no other reason."""
    text = messages.withColumn("raw", F.col("value").cast("string"))
    wire = wire_lines(text, ["raw", *keep], fields, malformed="__malformed")
    checks = [(~has_key(key), "no_key")] if key else []
    checks += [(bad & (F.col(name) != ""), f"unread:{name}")
               for name, bad in unread_numbers(fields, money).items()]
    malformed = F.col("__malformed").isNotNull() | F.col("raw").isNull()
    reasons = F.when(malformed, F.array(F.lit("not_json"))).otherwise(_codes(*checks))
    return wire.withColumn(REASONS, reasons).drop("__malformed")


def judge_cells(rows: DataFrame, needed: Sequence[str] | None = None) -> DataFrame:
    """Rows of text cells with `reasons`: the cells among `needed` that mean "no value"."""
    checks = [(missing_to_null(column(name)).isNull(), f"missing:{name}")
              for name in needed or rows.columns]
    return rows.withColumn(REASONS, _codes(*checks))


def verdict() -> Column:
    return F.when(F.size(REASONS) == 0, KEPT).otherwise(REJECTED)


def kept(judged: DataFrame) -> DataFrame:
    return judged.where(F.size(REASONS) == 0).drop(REASONS)


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where(F.size(REASONS) > 0)


def reason_counts(judged: DataFrame) -> DataFrame:
    """(reason, rows): rows per reason, `kept` for those without one, and `read` for all. A row
    with several reasons counts for each."""
    each = judged.select(F.explode(F.concat(F.array(F.lit("read")), F.when(
        F.size(REASONS) == 0, F.array(F.lit(KEPT))).otherwise(F.col(REASONS)))).alias("reason"))
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
