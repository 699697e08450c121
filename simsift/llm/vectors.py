"""Vector columns of Arrow batches, shared by the operators on ``embeddings``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MOST = float(1 << 62)


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a vector to use, their vectors as one double matrix).  A null or
    empty vector, or one with a null or non-finite component, is not used.
    Vectors of different lengths raise ValueError."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()                                  # without the values of null rows
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)   # nulls become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(size)
    rows = np.flatnonzero((size > 0) & (bad[ends] == bad[ends - size]))
    if not len(rows):
        return rows, np.zeros((0, 0))
    width = size[rows[0]]
    if (size[rows] != width).any():
        raise ValueError("vectors of different lengths")
    if len(rows) * width == len(values):
        return rows, values.reshape(len(rows), width)
    return rows, values[(ends - size)[rows][:, None] + np.arange(width)]


def floored(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * component)`` as int64; beyond 2^62 ValueError."""
    out = np.floor(vectors * float(scale))
    if out.size and np.abs(out).max() > _MOST:
        raise ValueError(f"a component times {scale} does not fit a long")
    return out.astype(np.int64)


def vector_lists(rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)),
                                    pa.array(np.ascontiguousarray(rows).ravel()))
