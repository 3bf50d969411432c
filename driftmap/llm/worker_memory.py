"""Memory that a Python worker gives back at the end of a task.

Workers live on from stage to stage. What Arrow's pool and the C allocator keep
for reuse adds up with what the next stage's operator needs.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Return unused memory to the system; allocators without ``malloc_trim`` keep theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
