"""Arrow batches in short pieces, so that a Python worker's memory is a piece and not a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes at which a batch from Spark to Python ends. Spark's own 64 MB are held by each task twice in the executor, as buffers grow, and once in the worker.
SENT, _LIMIT = 1 << 21, "spark.sql.execution.arrow.maxBytesPerBatch"


def send_short(spark: SparkSession) -> None:
    """Batches to Python workers end at SENT bytes in this session, or one longer row, unless the session has a limit of its own."""
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, SENT)


def give_back() -> None:
    """Hand freed memory back to the system: workers are used again, and what allocators keep adds up over stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 1 << 19, column: int | str = 1) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``rows`` rows and ``size`` bytes (list elements) of ``column`` at most, or one longer row."""
    for batch in batches:
        values = batch.column(column)
        measure = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        sizes = pc.fill_null(measure(values), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, batch.num_rows, max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1))
            yield batch.slice(at, to - at)
            at = to
        del batch, values
        give_back()
