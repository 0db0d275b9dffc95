"""Operator 12: whitening of embeddings by the covariance of their distinct vectors, weighted by multiplicity.

Entries are whole numbers (a fixed-point grid), so equal vectors are found by value. Each distinct vector is kept once
with its count, which is its weight in the fit (or one, if repeats are not to count). Sums are exact; the covariance is a
weighted product of centred blocks, one small matrix a task, added up by Spark. Its eigenvectors are those of a matrix as
wide as a vector, found on the driver. Each distinct vector is whitened once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.storage import stage

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 30)  # entries from here on have no place on the grid
ROWS = 4096


def grid_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, x``: rows with a vector of finite components only, each as ``floor(1024 c) + 100000``."""
    v = F.col(vec_col).cast("array<double>")
    good = (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    on_grid = F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT)
    return table.where(F.col(vec_col).isNotNull()).where(good).select(F.col(id_col).alias("id"), on_grid.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of ``x, m`` batches: the part, its vectors as a matrix of longs, its weights."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1), part.column(1).to_numpy()


class Centre:
    """Number, sums and centred values of a weighted list of whole-number vectors."""

    def __init__(self, n: int, sums: list[int], largest: int) -> None:
        self.n, self.sums = n, sums
        self.exact = 2 * n * largest < 1 << 62  # products fit in a long; beyond that they are Python numbers
        self.safe = len(sums) * (2 * n * largest) ** 2 < 1 << 63

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """``n x - S`` without rounding."""
        kind = np.int64 if self.exact else object
        return self.n * x.astype(kind) - np.array(self.sums, dtype=kind)

    def deviation(self, scaled: np.ndarray) -> list:
        """Sums of squares of the rows of ``scaled``; null where they exceed a long."""
        if self.safe:
            return (scaled * scaled).sum(1).tolist()
        total = [sum(int(v) ** 2 for v in row) for row in scaled]
        return [t if t < 1 << 63 else None for t in total]

    def centred(self, scaled: np.ndarray) -> np.ndarray:
        return scaled.astype(np.float64) / self.n


def fit_centre(classes: DataFrame) -> Centre:
    """Over ``x, m``: one pass, a row a dimension and task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, largest = None, 0, 0
        for _, x, m in _blocks(batches):
            largest = max(largest, int(np.abs(x).max()))
            if largest * int(m.sum()) < 1 << 62:
                part = (x * m[:, None]).sum(0).tolist()
            else:
                part = (x.astype(object) * m[:, None].astype(object)).sum(0).tolist()
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            n += int(m.sum())
        if total is not None:
            rows = [{"i": i, "s": str(s), "n": n, "top": largest} for i, s in enumerate(total)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("i", pa.int32()), ("s", pa.string()), ("n", pa.int64()), ("top", pa.int64())]))

    parts = classes.select("x", "m").mapInArrow(sums, "i int, s string, n long, top long")
    rows = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"), F.max("top").alias("top")).orderBy("i").collect()
    return Centre(rows[0]["n"], [int(r["s"]) for r in rows], max(r["top"] for r in rows))  # a row a dimension


def fit_covariance(classes: DataFrame, centre: Centre) -> np.ndarray:
    """Weighted covariance of ``x, m``, divisor n: blocks are centred, then multiplied."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x, m in _blocks(batches):
            c = centre.centred(centre.scaled(x))
            part = (c * m[:, None]).T @ c
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), type=pa.int32()), pa.array(list(total), type=pa.list_(pa.float64()))], names=["i", "row"])

    parts = classes.select("x", "m").mapInArrow(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    rows = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # the square of the dimensions
    out = np.zeros((len(centre.sums),) * 2)
    for r in rows:
        out[r["i"], r["j"]] = r["v"] / centre.n
    return (out + out.T) / 2


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first eigenvalues in falling order, their unit eigenvectors (columns; largest entry positive) and shares of the trace."""
    e, v = np.linalg.eigh(covariance)
    e, v = np.maximum(e[::-1], 0.0)[:components], v[:, ::-1][:, :components]
    v = v * np.sign(v[np.abs(v).argmax(0), range(v.shape[1])])
    trace = float(np.trace(covariance))
    return e, v, e / trace if trace > 0 else np.full(len(e), np.nan)


def whiten(table: DataFrame, components: int = 8, weights: str = "count", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per remaining row and component: ``id_col, component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null, empty or holds null or non-finite entries, or entries of 2**30 or more, are left out, and
    so are those of other than the most common length (ties: the shorter). ``weights`` is ``"count"`` (each row counts in the
    fit) or ``"one"`` (each distinct vector once). ``n`` is the sum of weights, ``deviation`` the sum over dimensions of
    (n x - S)**2 (null beyond a long), ``whitened`` the centred vector on the unit eigenvector over the root of its eigenvalue,
    ``explained`` the eigenvalue's share of the trace, ``identity_error`` the largest absolute entry of the whitened columns'
    covariance minus the identity. A component without variance (within rounding) can't be whitened: its ``whitened`` is null and it is
    left out of ``identity_error``; with no variance at all ``explained`` and ``identity_error`` are null too. Null ids and repeated ids
    are rows like others. An empty table gives no rows. Only matrices as wide as a vector come to the driver.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights are 'count' or 'one'")
    id_type = table.schema[id_col].dataType.simpleString()
    names = f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = stage(grid_vectors(table, id_col, vec_col), "grid")
    shape = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None:
        return table.sparkSession.createDataFrame([], names)
    rows = rows.where(F.size("x") == shape["d"])
    m = F.count("*") if weights == "count" else F.lit(1).cast("long")
    classes = stage(rows.groupBy("x").agg(m.alias("m")), "gridclasses")
    centre = fit_centre(classes)
    e, v, share = principal(fit_covariance(classes, centre), components)
    flat = e <= 1e-12 * e[0] if e[0] > 0 else np.ones(len(e), dtype=bool)
    to_unit = v / np.sqrt(np.where(flat, 1.0, e))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, _ in _blocks(batches):
            scaled = centre.scaled(x)
            white = [[None if f else float(w) for w, f in zip(row, flat, strict=True)] for row in centre.centred(scaled) @ to_unit]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(centre.deviation(scaled), type=pa.int64()), pa.array(white, type=pa.list_(pa.float64()))], names=["x", "m", "deviation", "w"])

    white = stage(classes.select("x", "m").mapInArrow(project, "x array<long>, m long, deviation long, w array<double>"), "whitened")
    error = _identity_error(white, centre.n, [i for i in range(len(e)) if not flat[i]])
    explained = F.array(*[F.lit(None if np.isnan(s) else float(s)).cast("double") for s in share])
    out = rows.join(white.drop("m"), "x").select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("k")].alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )


def _identity_error(white: DataFrame, n: int, useful: list[int]) -> float | None:
    """Largest absolute entry of the covariance of the whitened columns minus the identity; columns are centred first."""
    if not useful:
        return None
    w = [F.col("w")[i] for i in useful]
    mean = white.agg(*[(F.sum(F.col("m") * c) / n).alias(f"c{k}") for k, c in enumerate(w)]).first()
    centred = [c - F.lit(mean[k]) for k, c in enumerate(w)]
    cells = [(a, b) for a in range(len(w)) for b in range(a, len(w))]
    found = white.agg(*[(F.sum(F.col("m") * centred[a] * centred[b]) / n).alias(f"c{k}") for k, (a, b) in enumerate(cells)]).first()
    return reduce(max, (abs(found[k] - (a == b)) for k, (a, b) in enumerate(cells)))
