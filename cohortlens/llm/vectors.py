"""Vector columns as numpy matrices, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) for each length of vector in a list column, without null vectors and those that hold null or non-finite entries."""
    off = np.asarray(col.offsets, dtype=np.int64)
    length = np.diff(off)
    length[~np.asarray(col.is_valid())] = -1
    values = col.values
    flat = np.asarray(values.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    for d in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == d)
        m = flat[off[rows][:, None] + np.arange(d)]
        good = np.isfinite(m).all(axis=1)
        if good.any():
            yield rows[good], m[good]
