"""What the operators on vectors share: which vectors take part, copies, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def keyed(df: DataFrame, vector: str) -> DataFrame:
    """Adds k1, k2: a 128-bit key of the vector's components."""
    return df.withColumn("k1", F.xxhash64(vector)).withColumn("k2", F.xxhash64(F.lit(0x5EED), vector))


def matrices(column: pa.Array):
    """(rows, float64 matrix) for each length of vector in a list column without nulls."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[at[rows][:, None] + np.arange(d)]


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so squares of large components do not overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def join_groups(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of 0..n-1 reaches over the links i-j."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    while not np.array_equal(root[root], root):
        root = root[root]
    return root
