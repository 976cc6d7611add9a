"""What a Python worker keeps between batches: the state of one operator at a time.

Spark reuses Python workers, so that each operator's caches would stay beside the next one's.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], T]) -> T:
    """The worker's state under ``key``, made where it isn't there; any other state is dropped."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]  # type: ignore[return-value]
