"""Shared by the vector operators: valid vectors, classes of equal ones, bounded samples, k-means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, v)``: rows with an id and a vector that is not null, empty or zero and has finite components only."""
    v = F.col(vec_col).cast("array<double>")
    good = F.size(v) > 0
    good = good & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def matrix(column) -> np.ndarray:
    """Rows of a pandas column of equal-length arrays as one matrix of doubles."""
    return np.stack([np.asarray(x, dtype=np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def sample(vectors: DataFrame, n: int) -> np.ndarray:
    """The ``n`` vectors of smallest hash, at most: a bounded, repeatable sample for codebooks."""
    rows = vectors.select(F.xxhash64("v").alias("h"), "v").orderBy("h").limit(n).collect()
    return np.array([r["v"] for r in rows], dtype=np.float64)


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of ``x``, ``k`` of them or one per row if there are fewer rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=len(centres))
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squared(x, centres).argmin(1)
