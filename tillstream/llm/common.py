"""What several operators use: ASCII lower case, a shared written table, file shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.session import work_folder

# Texts handled at a time inside a task are cut into groups of about so many bytes.
SLICE_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage, survives lost executors."""
    path = work_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{package.name}-code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def mapped(frame: DataFrame, step: Callable[[Iterable[pa.RecordBatch]], Iterator], schema: str
           ) -> DataFrame:
    """`mapInArrow` with this package at hand in the workers."""
    ship_code(frame.sparkSession)
    return frame.mapInArrow(step, schema)


def slices(values: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, list]]:
    """Consecutive texts or binaries of about `size` bytes together, one at least, as
    (start, end, values); only those at hand are Python objects."""
    lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield start, end, values.slice(start, end - start).to_pylist()
        start = end


def crc_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; NULL ids have none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def hash_share(key: Column, share: Column | float) -> Column:
    """True for about `share` of all keys, always the same ones."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 30)) < share * F.lit(float(1 << 30))


class ShippedArrays:
    """Named arrays in one file that every executor fetches once and maps into memory."""

    def __init__(self, spark: SparkSession, arrays: dict[str, np.ndarray]):
        self.name = f"arrays-{uuid.uuid4().hex}.bin"
        self.places = {}
        path = os.path.join(tempfile.mkdtemp(prefix="ship-"), self.name)
        with open(path, "wb") as out:
            for name, array in arrays.items():
                out.write(b"\0" * (-out.tell() % 8))
                self.places[name] = (out.tell(), array.dtype.str, array.shape)
                out.write(np.ascontiguousarray(array).tobytes())
            out.write(b"\0" * 8)
        spark.sparkContext.addFile(path)

    def open(self) -> dict[str, np.ndarray]:
        whole = np.memmap(SparkFiles.get(self.name), dtype=np.uint8, mode="r")
        out = {}
        for name, (start, dtype, shape) in self.places.items():
            size = int(np.prod(shape)) * np.dtype(dtype).itemsize
            out[name] = whole[start:start + size].view(dtype).reshape(shape)
        return out
