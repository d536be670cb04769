"""What a Python worker keeps between tasks.

Workers outlive tasks and serve all operators of a session. Tables that an operator learns as it goes
are worth keeping for its next task, but not beyond: one operator's tables at a time are kept, and
tasks of an operator that keeps none let go of them.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")

_kept: dict[tuple, object] = {}
#: Only glibc has it.
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def kept(key: tuple, make: Callable[[], T]) -> T:
    """The table of that key, made anew unless it is the one that this worker keeps."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Let go of what other operators kept."""
    if _kept:
        _kept.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Give memory that is free back to the system, so that an idle worker is a small one."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)
