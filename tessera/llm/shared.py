"""What the operators share: tables in the shared folder, and views of Arrow text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame

from ..plans.storage import discard, read_table, shared_dir, small, written

__all__ = ["arrow_map", "discard", "read_table", "shared_dir", "slices", "small", "text_bytes", "texts_of", "written"]


#: bytes of rows that Spark hands to Python at once
ARROW_BYTES = 8 << 20
_BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """df.mapInArrow for texts of any length: the session's limit of bytes in a batch goes down to ARROW_BYTES if it is higher, and
    a worker that has done a partition gives the memory it no longer needs back to the system."""
    spark = df.sparkSession
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BYTES_PER_BATCH))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(_BYTES_PER_BATCH, str(ARROW_BYTES))

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc alone has it
        libc.malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows of a string or binary column, one after the other, and the rows' bounds in them. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def texts_of(column: pa.Array) -> list[str]:
    """Null is empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batches, most_bytes: int, column: str = "text"):
    """Record batches cut so that the named column of each holds about most_bytes (a single longer row is a batch)."""
    for batch in batches:
        at = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(at, upto - at)
            at = upto
