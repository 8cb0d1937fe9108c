"""What Python workers keep between tasks."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim  # glibc only
except (AttributeError, OSError):
    _trim = None


def release() -> None:
    """Gives freed memory back to the system; allocators would keep it for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def releasing(run):
    """A mapInArrow function that releases what it has freed as it ends.

    A worker lives through all stages of a query, so that it would hold the most that any of them took
    beside what the next one takes.
    """

    @functools.wraps(run)
    def end(batches):
        yield from run(batches)
        release()

    return end
