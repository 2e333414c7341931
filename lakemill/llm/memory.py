"""Memory of Python workers.

Spark keeps workers for later tasks, beside whatever the JVM of their executor does meanwhile. Allocators keep what was
freed, so that a waiting worker would hold the memory of its largest slice or block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Free memory that the allocators keep goes back to the system (the C library's where that is glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``work`` over a task's batches, for ``mapInArrow``; a worker that has ended it holds no memory of it."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def spared(made: pa.Table) -> pa.Table:
    """What a group's work has made, once what the work took has gone back; for ``applyInArrow``."""
    give_back()
    return made
