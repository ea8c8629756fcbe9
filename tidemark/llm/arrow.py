"""Bounds of the Arrow batches that Python workers get, and of what the workers keep."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a batch, where the session doesn't set another bound.
BATCH_BYTES = 8_000_000
#: The same for operators that share a session with many others: each batch has buffers in the JVM too.
SMALL_BATCH_BYTES = 2_000_000
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound batches by bytes: 10,000 rows of long text would not fit into a worker."""
    if int(spark.conf.get(KEY, str(2**31 - 1))) > most:
        spark.conf.set(KEY, str(most))


#: What this worker keeps beyond a task, by operator.
_KEPT: dict[str, dict] = {}


def kept(operator: str, key: tuple, make: Callable):
    """An object that outlives a task, until the worker gets one of another operator."""
    own = _KEPT.setdefault(operator, {})
    if key not in own:
        own[key] = make()
    return own[key]


def lean(operator: str, run: Callable) -> Callable:
    """Task ``run`` in a worker that serves many operators in turn: what others kept goes first, and freed memory goes
    back to the system at the end. Idle workers would otherwise hold the most that any task of theirs took."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in _KEPT.keys() - {operator}:
            del _KEPT[other]
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Return freed memory to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
