"""Arrow columns a few rows at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

#: Rows whose Python values are held at once.
SLICE = 128


def release() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def by_slices(function: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """What a function from lists of values to a list gives of columns, without Python values of a whole batch."""
    out = [pa.array(function(*(c.slice(k, SLICE).to_pylist() for c in columns)), kind) for k in range(0, len(columns[0]), SLICE)]
    found = pa.concat_arrays(out) if out else pa.array([], kind)
    del out
    release()
    return found
