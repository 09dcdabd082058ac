"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa

_kept: dict[str, dict] = {}


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


def state(owner: str) -> dict:
    """This worker's memory for ``owner``; that of any other operator is freed.

    Workers live longer than a stage, so each operator calls this when a task
    begins, also one that keeps nothing.
    """
    if owner not in _kept:
        _kept.clear()
        gc.collect()
        release()
    return _kept.setdefault(owner, {})
