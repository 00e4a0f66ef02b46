"""What Python workers keep between tasks.

Spark reuses a worker for the tasks of later stages. An operator that keeps a
table between its own tasks registers how to forget it, and the tasks of
another operator in the same worker begin by having it forgotten, so that a
worker never holds the tables of two operators.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa

_forget: dict[str, Callable[[], None]] = {}


def keeps(operator: str, forget: Callable[[], None]) -> None:
    """``forget`` frees what ``operator`` keeps in this worker."""
    _forget[operator] = forget


def begin(operator: str) -> None:
    """A task of ``operator`` starts: free what other operators have kept."""
    others = [f for name, f in _forget.items() if name != operator]
    for forget in others:
        forget()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
