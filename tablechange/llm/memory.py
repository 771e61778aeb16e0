"""Memory of Python workers, which live on between tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for ``mapInArrow`` that gives memory back at the end of its partition. A worker keeps what it
    freed otherwise, and an executor holds the peaks of all stages of a job at once."""

    @wraps(run)
    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return tidied
