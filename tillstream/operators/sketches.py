"""Distributions that add up: quantile sketches per group, merged for any span of groups.

A sketch is some kilobytes whatever it has seen, and sketches merge into the sketch of all they
have seen. Stored once per epoch or day, they give quantiles and bins over any span without
reading the rows again. The counts are close, not exact: `RANK_ERROR` bounds a rank's error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.operators.readside import HISTOGRAM_BINS

SIZE = 800  # items a sketch keeps per level
# Published bound of the sketch for this size: 99 of 100 ranks are this close, as a share of rows.
RANK_ERROR = 0.004


def sketch(rows: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """(keys, sketch, low, high, n): the distribution of a measure per group, NULLs left out.
    Tasks sketch their own rows, so a group that holds a third of them sends one sketch per task."""
    values = rows.where(F.col(measure).isNotNull()).withColumn("__v", F.col(measure).cast("double"))
    return values.groupBy(*keys).agg(
        F.kll_sketch_agg_double("__v", F.lit(SIZE)).alias("sketch"),
        F.min("__v").alias("low"), F.max("__v").alias("high"), F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sketches of groups to sketches of fewer groups, by default one."""
    return sketches.groupBy(*keys).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.sum("n").alias("n"))


def quantile(share: Column | float) -> Column:
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.kll_sketch_get_quantile_double("sketch", share)


def histogram(merged: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, customers, bin_start, bin_end) like `readside.histogram`, of one merged sketch; each
    count is within twice `RANK_ERROR` of all rows. Bins that nothing falls into have no row.

    Ranks are asked for at fixed edges, so the driver gets the ends: two numbers."""
    ends = merged.select("low", "high").first()
    if ends is None or ends.low is None:
        return merged.select(F.lit(1).alias("bin"), F.col("n").alias("customers"), F.col(
            "low").alias("bin_start"), F.col("high").alias("bin_end")).limit(0)
    bins = bins if ends.high > ends.low else 1
    width = (ends.high - ends.low) / bins
    edges = [ends.low + number * width for number in range(bins)] + [ends.high]
    # Shares of values below an edge; an edge belongs to the bin above it, but for the last one.
    below = [F.lit(0.0), *[F.kll_sketch_get_rank_double("sketch", F.lit(edge))
                           for edge in edges[1:-1]], F.lit(1.0)]
    found = F.array(*[
        F.struct(F.lit(number + 1).alias("bin"),
                 F.round((below[number + 1] - below[number]) * F.col("n")).cast("long").alias(
                     "customers"),
                 F.lit(edges[number]).alias("bin_start"), F.lit(edges[number + 1]).alias("bin_end"))
        for number in range(bins)])
    return merged.select(F.inline(found)).where("customers > 0")
