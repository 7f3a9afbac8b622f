"""Bounded slices of Arrow batches for operators that run in ``mapInArrow``."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE_BYTES = 2 << 20


def give_back() -> None:
    """Return freed memory to the system: workers stay alive between tasks and stages, several to an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``most`` bytes, or of one row where a row alone is larger."""
    for batch in batches:
        if batch.num_rows <= 1 or batch.nbytes <= most:
            if batch.num_rows:
                yield batch
            continue
        weights = [0] * batch.num_rows
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
                weights = [a + b for a, b in zip(weights, sizes, strict=True)]
        start, held = 0, 0
        for i, w in enumerate(weights):
            if i > start and held + w > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += w + 16
        yield batch.slice(start)
    give_back()
