"""What both vector operators share: usable vectors, Arrow matrices, k-means on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array<float> if the vectors are that, else array<double>) of rows that take part: no null, zero or non-finite vector, no null
    id, and as many components as most rows have."""
    # Floats are exact in double precision, where all is computed; they are half as much to move.
    v = F.col(vector_col).cast("array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two, so that no square overflows; directions stay exact."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if x.size else x


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True) if x.size else np.ones((len(x), 1))
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bounded_sample(rows: DataFrame, size: int) -> np.ndarray:
    """Unit vectors of at most `size` rows, those with the smallest hash of the id."""
    found = rows.orderBy(F.xxhash64("id"), "id").limit(size).select("v").toArrow()
    return unit(matrix(found["v"]))


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each row of `to`."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ to.T + (to * to).sum(1)[None], 0)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """At most k centres; started from distinct rows."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = np.concatenate([distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres
