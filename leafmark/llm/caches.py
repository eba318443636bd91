"""What a Python worker keeps between tasks: one operator's cache at a time.

Workers are used again by later stages; were each operator's cache to stay, they
would add up to more than a worker may hold.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_HELD: dict[Hashable, Any] = {}


def held(name: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's object of this name; making it lets go of any other."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]
