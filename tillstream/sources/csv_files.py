"""CSV in and out, all columns as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# A quote inside a quoted cell is written twice, and blanks around a cell belong to it.
_FORMAT = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
}

# A packed file cannot be split, so it holds no more rows than a task reads in seconds.
_PACKED = {
    "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": "1000000"}


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every column as text, no inference pass; a blank cell is NULL. Files stay splittable
    unless cells may contain line breaks (`multi_line`)."""
    # With a null text that no cell holds, a quoted empty cell stays an empty text.
    return spark.read.options(
        **_FORMAT, nullValue="\u0000", multiLine=str(multi_line).lower()
    ).csv(path)


def stream_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Files as they arrive, read like those of `read_csv`. All have the given columns."""
    layout = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    return spark.readStream.schema(layout).options(**_FORMAT, nullValue="\u0000").csv(path)


def write_csv(
    rows: DataFrame, path: str, mode: str = "overwrite", packed: bool = False
) -> None:
    """A folder of CSV files, each with a header; NULL becomes a blank cell, an empty text a
    quoted one. `packed` files take a quarter of the room and are read like the others."""
    how = {**_FORMAT, **(_PACKED if packed else {})}
    rows.write.mode(mode).options(**how, emptyValue='""').csv(path)
