"""Memory of reused Python workers."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa

_last: str | None = None


def enter(owner: str) -> None:
    """Says whose work a Python worker does now; what it kept for another's is given back to the system.

    Spark reuses workers from stage to stage, so without this a tokenizer's tables and freed buffers would
    stand beside those of the next operator.
    """
    global _last
    if _last not in (None, owner):
        if tokens := sys.modules.get("foliolake.llm.tokens"):
            tokens.forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
    _last = owner
