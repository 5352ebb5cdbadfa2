"""Expressions over array columns that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with the value computed once per row."""
    return F.transform(F.array(value), then)[0]


def running_sums(values: Column) -> Column:
    """Sums of the first 1, 2, ... values of an array of whole numbers.

    Works in blocks of the square root of the length, because an array grows by copying.
    """
    def append(sums: Column, value: Column) -> Column:
        return F.array_append(sums, value + F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)))

    none = F.array().cast("array<int>")

    def blocked(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        last = F.ceil(F.size(v) / size).cast("int") - 1
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(
            F.slice(v, k * size + 1, size), none, append))
        return let(blocks, shifted)

    def shifted(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.element_at(b, -1))
        return let(F.aggregate(ends, none, append), lambda totals: F.flatten(F.transform(
            blocks, lambda b, k: F.transform(b, lambda x: x + F.coalesce(
                F.get(totals, k - 1), F.lit(0))))))

    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(blocked(v)))
