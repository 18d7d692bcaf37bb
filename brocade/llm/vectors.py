"""Vectors of Arrow list columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite_rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of the vectors that are neither null nor empty and hold no null or non-finite component."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    out = []
    for d in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == d)
        x = flat[begin[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1)
        if good.any():
            out.append((rows[good], x[good]))
    return out


def usual_length(lengths: dict[int, int]) -> int:
    """The length that most vectors have, the longer one of ties; 0 if there are none."""
    return max(lengths, key=lambda d: (lengths[d], d), default=0)
