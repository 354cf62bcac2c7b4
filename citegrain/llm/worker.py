"""Caches of a Python worker: workers are reused by later tasks, so each holds those of the operator at work alone."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_HELD: list[tuple[str, Callable[[], None]]] = []


def take_over(name: str, drop: Callable[[], None] = lambda: None) -> None:
    """Called as a task begins: another operator's caches are dropped, and their memory goes back to the system."""
    if _HELD and _HELD[-1][0] == name:
        return
    held = [_HELD.pop() for _ in range(len(_HELD))]
    _HELD.append((name, drop))
    if not held:
        return
    for _, old in held:
        old()
    gc.collect()
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass
