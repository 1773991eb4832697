"""What a Python worker keeps from one task to the next.

Spark hands a worker from stage to stage, each with another operator. Unused memory goes back to the system
after each batch, and a large table of one operator goes before a task of another one begins, so that a
worker takes what its task needs and not the sum of all tasks before.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

_held: dict[str, tuple[Any, Any]] = {}
#: Only glibc keeps freed memory back and has this call.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def held(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """A table that tasks with the same key share: one of each kind per worker process."""
    if kind not in _held or _held[kind][0] != key:
        _held.pop(kind, None)  # before the next one is made
        _held[kind] = key, make()
    return _held[kind][1]


def give_back() -> None:
    """Return memory that is not in use to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _begin(holds: str | None) -> None:
    for kind in [k for k in _held if k != holds]:
        del _held[kind]
    give_back()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch
        give_back()


def lean(task: Task, holds: str | None = None) -> Task:
    """The same task for ``mapInArrow``, with the same rows; ``holds`` is the kind of table that it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only functions of this module here: its own variables would be sent along as copies
        _begin(holds)
        yield from task(_each(batches))
        give_back()

    return run
