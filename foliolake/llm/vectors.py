"""What the vector operators share: valid vectors of a table, numpy matrices, centres to gather rows by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column, zero: bool = False) -> Column:
    """Whether a vector is not null or empty and all its components are finite; with zero, not all 0 either."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = vector.isNotNull() & (F.size(vector) > 0) & finite
    if zero:
        ok = ok & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows x width doubles of a list column; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    values = np.asarray(column.flatten().cast(pa.float64()))
    if (n == width).all():
        return values.reshape(len(n), width).copy()
    out = np.zeros((len(n), width))
    rows = np.repeat(np.arange(len(n)), n)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all centres."""
    square = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    return np.sqrt(np.maximum(square, 0))


def centres(x: np.ndarray, n: int, rounds: int = 6, rows: bool = False) -> np.ndarray:
    """Up to n centres of the rows of x: rows far from each other, then a few rounds of means; the same for the same x.

    With `rows`, the rows nearest to those means instead of the means.
    """
    if not len(x) or n < 1:
        return x[:0]
    chosen = [int((x * x).sum(1).argmax())]
    gap = np.sqrt(((x - x[chosen[0]]) ** 2).sum(1))
    while len(chosen) < min(n, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(1)))
    out = x[chosen].copy()
    for _ in range(rounds):
        near = distances(x, out).argmin(1)
        counts = np.bincount(near, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, near, x)
        out[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return x[np.unique(distances(out, x).argmin(1))] if rows else out


def narrowest(largest: float) -> np.dtype:
    """The smallest type of whole numbers that holds everything up to `largest` in size, doubles beyond 32 bits."""
    return np.dtype("<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8")
