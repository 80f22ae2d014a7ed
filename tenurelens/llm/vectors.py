"""Vector columns: which rows take part, and matrices from Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Values of a sample that the driver fits a basis or centroids on.
SAMPLE_VALUES = 4_000_000


def usable(vector: Column) -> Column:
    """Not NULL, not zero, and without NULL, NaN or infinite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return values.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def sampled(vectors: DataFrame, key: str, column: str, rows: int, width: int, most: int, seed: int) -> np.ndarray:
    """At most about ``most`` vectors, chosen by hash over all rows, in the same order each time."""
    most = max(1, min(most, SAMPLE_VALUES // max(width, 1)))
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30))
    some = vectors.where(place <= int(min(1.0, most / max(rows, 1)) * (1 << 30))).select(F.col(key).alias("k"), column)
    table = some.toArrow().sort_by("k")
    return matrix(table[column], width)


def top_pairs(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` largest scores, ties at the end to the smaller id; -inf never counts."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        rows, cols = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    else:
        rows, cols = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows, "left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep]
