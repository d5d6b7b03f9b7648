"""What a Python worker keeps between tasks."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
_kept: dict[str, tuple[str, object]] = {}


def once_per_process(kind: str, name: str, make: Callable[[], T]) -> T:
    """``make()``, or what it gave for the last ``name`` of this ``kind``; one thing of a kind is kept."""
    if kind not in _kept or _kept[kind][0] != name:
        _kept[kind] = (name, make())
    return _kept[kind][1]
