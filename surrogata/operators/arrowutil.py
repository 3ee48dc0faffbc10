"""Arrow <-> numpy helpers used inside ``mapInArrow`` tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def list_to_matrix(col) -> np.ndarray:
    """A list<double|float> Arrow column with equal lengths -> (n, d) float64."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.empty((0, 0))
    if col.null_count:
        raise ValueError("null vectors are not allowed")
    if pa.types.is_fixed_size_list(col.type):
        d = col.type.list_size
        vals = col.flatten().to_numpy(zero_copy_only=False)
        return vals.astype(np.float64, copy=False).reshape(n, d)
    offsets = col.offsets.to_numpy()
    lens = np.diff(offsets)
    d = int(lens[0])
    if not np.all(lens == d):
        raise ValueError("vectors of unequal length in one column")
    vals = col.flatten().to_numpy(zero_copy_only=False)
    return vals.astype(np.float64, copy=False).reshape(n, d)


#: Numbers that a block of rows holds (8 MB).
BLOCK_NUMBERS = 1 << 20


def matrix_blocks(col, numbers: int = BLOCK_NUMBERS):
    """``list_to_matrix`` of runs of rows, each of at most so many numbers (one row at least)."""
    low = 0
    while low < len(col):
        width = len(col[low]) if col[low].is_valid else 1
        rows = max(1, numbers // max(1, width))
        yield list_to_matrix(col.slice(low, rows))
        low += rows


def vector_or_scalar(col) -> np.ndarray:
    """A scalar double column becomes (n, 1); a list column (n, p)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_list(col.type) or pa.types.is_large_list(col.type) or pa.types.is_fixed_size_list(col.type):
        return list_to_matrix(col)
    return col.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 1)


def matrix_to_list(M: np.ndarray) -> pa.Array:
    """(n, d) float64 -> list<double> Arrow array."""
    M = np.ascontiguousarray(M, dtype=np.float64)
    n, d = M.shape
    offsets = pa.array(np.arange(0, n * d + 1, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(M.ravel()))
