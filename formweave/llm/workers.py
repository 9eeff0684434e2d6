"""What a Python worker keeps from task to task.

Workers outlive the stages of a pipeline and count to their executor's memory, idle or not.  So a worker
holds one memo (a vocabulary, a model with the words that it has judged), that of the operator at work.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

_HELD: list = [None, None]


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """This worker's memo ``key``, made where it is not the one held; what was held before is given up."""
    if _HELD[0] != key:
        if _HELD[0] is not None:
            _HELD[:] = [None, None]
            give_back()
        _HELD[:] = [key, make()]
    return _HELD[1]


def give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)
