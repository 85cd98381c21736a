"""Vectors as exact integers: list columns of Arrow batches as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Components from here on have no exact scores in 64 bits.
LIMIT = 2**26


def lengths(column: pa.Array) -> np.ndarray:
    """The number of components of each vector; -1 for null."""
    return pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def scaled(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) as doubles, a row of `width` for each vector: 0 beyond its end, NaN where x is null or not finite."""
    n = np.maximum(lengths(column), 0)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    # Past 2**60 all are alike: far beyond LIMIT, and not infinite.
    flat = np.where(np.isfinite(flat), np.floor(np.clip(np.nan_to_num(flat), -(2.0**60) / scale, 2.0**60 / scale) * scale), np.nan)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out, inside = np.zeros((len(n), width)), np.arange(width) < n[:, None]
    out[inside] = flat  # rows are no longer than width, so that the places inside them are all of flat, in its order
    return out
