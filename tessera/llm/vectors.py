"""Vector columns of Arrow batches as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) for each length of vector there is; null vectors and those with null or non-finite entries are left out."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    held = np.maximum(size, 0)
    begin = np.cumsum(held) - held
    good = size >= 0
    good[np.repeat(np.arange(len(size)), held)[~np.isfinite(flat)]] = False
    for n in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == n))
        yield rows, flat[begin[rows][:, None] + np.arange(n)]


def whole(x: np.ndarray, most: int) -> np.ndarray:
    """floor(x) as 64-bit integers; what lies beyond +-most is held there."""
    return np.clip(np.floor(x), -most, most).astype(np.int64)
