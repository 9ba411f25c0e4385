"""Squared Euclidean distance: as a column, and as array kernels for blocks.

All add up in double precision from the first component to the last, so the
column, the kernels and a left fold in SQL agree to the last bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors differ in dimension")
    return flat.reshape(len(column), -1)


def l2_squared(a: Column | str, b: Column | str) -> Column:
    """Squared distance of two arrays of equal size; an error for unequal ones, null if either is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("double"))


def l2_slice(a: Column, b: Column, start: int, length: int) -> Column:
    """Squared distance over ``length`` components from ``start`` (counted from 0)."""
    return l2_squared(F.slice(a, start + 1, length), F.slice(b, start + 1, length))


def block_l2(queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Squared distances, queries x base rows."""
    if queries.shape[1] != base.shape[1]:
        raise ValueError("vectors differ in dimension")
    if len(queries) == 1 and base.shape[1]:
        return row_l2(queries, base)[None]
    total = np.zeros((len(queries), len(base)))
    for d in range(base.shape[1]):
        gap = queries[:, d][:, None] - base[:, d][None]
        gap *= gap
        total += gap
    return total


def row_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows beside them (or of one row to all)."""
    gap = a - b
    gap *= gap
    return np.add.accumulate(gap, axis=1)[:, -1]


def adc_table(query: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """chunks x centroids: squared distance of each chunk of a query to each centroid of that chunk."""
    chunks, centroids, width = pivots.shape
    total = np.zeros((chunks, centroids))
    for d in range(width):
        gap = pivots[:, :, d] - query.reshape(chunks, width)[:, d][:, None]
        total += gap * gap
    return total


def adc_distances(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sum over chunks of each row's table entries; ``codes``: rows x chunks."""
    total = np.zeros(len(codes))
    for c in range(codes.shape[1]):
        total += tables[c, codes[:, c]]
    return total


#: The same fold in DuckDB; ``{a}`` and ``{b}`` are arrays.
SQL_L2 = "list_reduce(list_transform(list_zip({a}, {b}), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)), lambda p, q: p + q)"


def sql_l2(a: str, b: str) -> str:
    """DuckDB text of the squared distance of two array expressions."""
    return SQL_L2.format(a=a, b=b)
