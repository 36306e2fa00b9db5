"""What a Python worker keeps between tasks: the cache of one operator, that which ran last, and little else."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

_held: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """The object under ``key``, made if it is not there; all others are let go."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Lets go of everything and gives freed memory back, so that idle workers leave it to others."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for an operator that keeps nothing: the worker is empty before it and after it."""

    def tidied(batches: Iterator) -> Iterator:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
