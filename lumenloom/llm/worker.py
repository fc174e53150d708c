"""What a Python worker holds between tasks: the tables of one operator at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_forget: list[Callable[[], None]] = []
_current: str | None = None


def holds(forget: Callable[[], None]) -> None:
    """Register how to let go of a module's tables."""
    _forget.append(forget)


def enter(operator: str) -> None:
    """Call first in a task. Workers serve many operators in turn: what another one has kept is let go, and freed memory goes back to the system."""
    global _current
    if _current not in (None, operator):
        for forget in _forget:
            forget()
        gc.collect()
    _current = operator
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it keeps
