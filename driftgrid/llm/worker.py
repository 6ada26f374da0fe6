"""What a Python worker remembers from task to task.

Spark hands the same worker processes to one stage after the other. So a worker
keeps the tables of one operator only, and frees them when another needs room.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable

_HELD: dict[Hashable, object] = {}


def held(key: Hashable, build: Callable[[], object]):
    """What ``build`` made for ``key``, kept until another key is asked for."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = build()
    return _HELD[key]
