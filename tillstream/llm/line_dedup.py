"""Line deduplication by frequency within a site.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it over
the number of the host's pages, and lines above the boilerplate ratio are dropped. Copies of one
page count once, so a page that was crawled many times is not taken for boilerplate. All of it
is DataFrame functions: each task reduces its lines to (host, line, page) hashes, which are
counted in two steps, so a host or a line that fills a third of the pages is added up before it
meets in one place.

Results: a NULL text stays NULL and is no page; an empty text stays empty. Lines are compared
without surrounding spaces; blank lines are kept and never counted. NULL hosts are one site.
Repeated rows are copies of one page. An empty table stays empty. All other columns of the input
stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm import common

MAX_RATIO = 0.02  # lines on a larger share of a host's pages are boilerplate
MIN_PAGES = 3  # and on so many of its pages at least


def _lines(text):
    return F.filter(F.split(text, "\n", -1), lambda line: F.trim(line) != "")


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text",
                max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): per host the hashes of its boilerplate lines.

    The ratios of a host's lines add up to its mean number of lines per page, so a host has at
    most that mean over `max_ratio` such lines.
    """
    pages = docs.where(F.col(text).isNotNull()).select(
        F.col(host).alias("host"), F.xxhash64(text).alias("page"), F.col(text).alias("text"))
    totals = pages.select("host", "page").distinct().groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"))
    lines = pages.select("host", "page", F.explode(F.array_distinct(F.transform(
        _lines(F.col("text")), lambda line: F.xxhash64(F.trim(line))))).alias("line"))
    counts = lines.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= min_pages)
    common_lines = counts.join(
        totals.withColumnRenamed("host", "site"), F.col("host").eqNullSafe(F.col("site"))
    ).where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    return common_lines.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text",
                     max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
                     dropped: str | None = None) -> DataFrame:
    """The documents with boilerplate lines taken out of `text`; `dropped` names a column for
    the number of lines that went."""
    # Written first, so that the planner knows its size: it is broadcast only if small, and
    # joined by shuffle, with hot hosts split at run time, otherwise.
    found = common.written(boilerplate(docs, host, text, max_ratio, min_pages), "boilerplate")
    # Names that no column of the documents has.
    site, listed = (name + "_" * (max(map(len, docs.columns)) + 1) for name in ("site", "lines"))
    found = found.select(F.col("host").alias(site), F.col("lines").alias(listed))
    both = docs.join(found, F.col(f"`{host}`").eqNullSafe(F.col(site)), "left")
    every = F.split(F.col(text), "\n", -1)
    kept = F.filter(every, lambda line: (F.trim(line) == "") | ~F.array_contains(
        F.col(listed), F.xxhash64(F.trim(line))))
    cleaned = F.when(F.col(listed).isNull(), F.col(text)).otherwise(
        F.array_join(kept, "\n"))
    columns = [cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if dropped:
        gone = F.when(F.col(listed).isNull(), F.lit(0)).otherwise(
            F.size(every) - F.size(kept))
        columns.append(F.coalesce(F.when(F.col(text).isNotNull(), gone), F.lit(0)).alias(dropped))
    return both.select(*columns)
