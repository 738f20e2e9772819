"""What a Python worker remembers from one task to the next: one table at a time, so stages don't add up."""

from __future__ import annotations

from collections.abc import Callable, Hashable

_LIVE: dict = {}


def remembered(key: Hashable, make: Callable):
    """What ``make`` gave for ``key`` when it was last asked for, if nothing else was asked for since."""
    if key not in _LIVE:
        _LIVE.clear()
        _LIVE[key] = make()
    return _LIVE[key]


def forget() -> None:
    """Drops it: for operators that remember nothing, but whose worker may have run others before."""
    _LIVE.clear()
