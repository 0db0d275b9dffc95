"""Operator 6: maximum inner product search with score-aware anisotropic quantisation.

Vectors are cut into short subspaces, each with 16 codewords (four bits). Codewords and codes minimise an
anisotropic loss: the part of the residual parallel to the vector, which shifts its inner products with
the queries that rank it high, weighs more than the orthogonal part. Queries and coded vectors meet in
blocks; each task scans four-bit lookup tables and reranks with exact inner products every candidate whose
scanned score, raised by the calibrated error, could still be among the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminar.llm.vectors import kmeans, matrix, sample, valid_vectors
from laminar.storage import stage

SAMPLE = 20_000
QUERY_BLOCK = 16_384
AT_ONCE = 512  # queries whose tables are held together
GROUPS = 64
SHARD = 16_384


class AnisotropicCoder:
    """Product codebooks of 16 words fit under the score-aware loss."""

    def __init__(self, x: np.ndarray, width: int = 2, parallel: float = 4.0, rounds: int = 4) -> None:
        self.width, self.parallel = width, parallel
        self.dim = x.shape[1]
        self.parts = [slice(a, min(a + width, self.dim)) for a in range(0, self.dim, width)]
        self.books = [kmeans(x[:, p], 16) for p in self.parts]
        for _ in range(rounds):
            codes = self.encode(x)
            self._refit(x, codes)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on ``|r|^2 + (parallel - 1) * (r . x/|x|)^2``."""
        unit = self._unit(x)
        codes = np.zeros((len(x), len(self.parts)), dtype=np.uint8)
        for s, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            codes[:, s] = ((x[:, p][:, None, :] - book[None]) ** 2).sum(2).argmin(1)
        along = ((x - self.decode(codes)) * unit).sum(1)
        for _ in range(sweeps):
            for s, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
                r = x[:, p][:, None, :] - book[None]
                part = (r * unit[:, p][:, None, :]).sum(2)
                rest = along - part[np.arange(len(x)), codes[:, s]]
                loss = (r * r).sum(2) + (self.parallel - 1) * (rest[:, None] + part) ** 2
                codes[:, s] = loss.argmin(1)
                along = rest + part[np.arange(len(x)), codes[:, s]]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], axis=1)

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each codeword to the minimum of the loss with all others fixed."""
        unit = self._unit(x)
        along = ((x - self.decode(codes)) * unit).sum(1)
        for s, p in enumerate(self.parts):
            u, v = unit[:, p], x[:, p]
            for w in range(len(self.books[s])):
                at = codes[:, s] == w
                if not at.any():
                    continue
                uu, vv = u[at], v[at]
                rest = along[at] - ((vv - self.books[s][w]) * uu).sum(1)
                a = at.sum() * np.eye(uu.shape[1]) + (self.parallel - 1) * uu.T @ uu
                b = vv.sum(0) + (self.parallel - 1) * (uu * (rest + (vv * uu).sum(1))[:, None]).sum(0)
                new = np.linalg.solve(a, b)
                along[at] = rest + ((vv - new) * uu).sum(1)
                self.books[s][w] = new

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Lookup tables (query, subspace, 16)."""
        out = np.full((len(q), len(self.parts), 16), -np.inf, dtype=np.float32)
        for s, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            out[:, s, : len(book)] = q[:, p] @ book.T
        return out

    def error(self, x: np.ndarray, top: int = 20) -> float:
        """How far scanned scores of high-ranking vectors fall short, relative to norms (largest seen, raised by half)."""
        q = x[:: max(1, len(x) // 200)]
        exact, scanned = q @ x.T, q @ self.decode(self.encode(x)).T
        best = np.argsort(-exact, 1)[:, :top]
        gap = np.abs(np.take_along_axis(exact - scanned, best, 1))
        scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[best]
        return float(1.5 * (gap / np.maximum(scale, 1e-300)).max()) if gap.size else 0.0


def pack_nibbles(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Scanned scores (vectors) of one query: two table lookups a byte, by a joint table of 256."""
    subs = tables.shape[0]
    if subs % 2:
        tables = np.concatenate([tables, np.zeros((1, 16), np.float32)])
    joint = (tables[1::2][:, :, None] + tables[0::2][:, None, :]).reshape(len(tables) // 2, 256)
    out = np.zeros(len(packed), dtype=np.float32)
    for s in range(joint.shape[0]):
        out += joint[s][packed[:, s]]
    return out


def _k_smallest_ids(good: DataFrame, k: int) -> DataFrame:
    """Per different vector: its ``k`` smallest ids; very large classes are thinned in 64 parts first."""
    salt = F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")
    parts = good.select(F.xxhash64("v").alias("h"), "v", salt, "id")
    one = parts.withColumn("r", F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("id"))).where(F.col("r") <= k)
    two = one.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= k)
    return two.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"))


def search(
    table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = SAMPLE
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest inner product for each row of ``queries``.

    A row is no candidate of its own query id; ties go to the smaller id; fewer candidates than ``k`` are
    all returned. Null, zero, empty and non-finite vectors, and vectors of another than the most common
    length, take no part on either side. Equal vectors are one class, scanned once, with their ``k + 1``
    smallest ids. Rows repeating an id keep the smallest vector. The coder is fit on the ``sample_rows``
    vectors of smallest hash; every vector is coded and scanned for every query.
    """
    good = stage(valid_vectors(table, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")), "mips")
    asked = valid_vectors(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    shape = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return table.sparkSession.createDataFrame([], empty)
    good = good.where(F.size("v") == shape["d"])
    asked = asked.where(F.size("v") == shape["d"])
    classes = stage(_k_smallest_ids(good, k + 1), "mipsclasses")
    n = classes.count()
    learn = sample(classes, sample_rows)
    coder = AnisotropicCoder(learn)
    error = coder.error(learn[:4000], k)
    shards = int(max(1, -(-n // SHARD)))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4000):
                part = batch.iloc[at : at + 4000]
                x = matrix(part["v"])
                yield pd.DataFrame({"rep": part["rep"], "ids": part["ids"], "code": [c.tobytes() for c in pack_nibbles(coder.encode(x))], "v": [r.tobytes() for r in x]})

    coded = classes.mapInPandas(encode, "rep long, ids array<long>, code binary, v binary")
    coded = stage(coded.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards))), "coded")
    # large blocks keep copies few: a vector goes to each block of queries, a query to each shard; small tables still fill the cores
    n_asked = asked.count()
    q_blocks = int(max(1, -(-n_asked // QUERY_BLOCK), min(-(-GROUPS // shards), -(-n_asked // 64))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(q_blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    known = coded.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<long>")))
    width = len(pack_nibbles(np.zeros((1, len(coder.parts)), np.uint8))[0])

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows: list = []
        if len(a) and len(b):
            b = b.sort_values("rep").reset_index(drop=True)
            q = matrix(a["v"])
            qn = np.linalg.norm(q, axis=1)
            x = np.frombuffer(b"".join(b["v"]), dtype=np.float64).reshape(len(b), -1)
            norms = np.linalg.norm(x, axis=1)
            packed = np.frombuffer(b"".join(b["code"]), dtype=np.uint8).reshape(len(b), width)
            ids = b["ids"].to_numpy()
            for r, qid in enumerate(a["id"].to_numpy()):
                if r % AT_ONCE == 0:
                    tables = coder.tables(q[r : r + AT_ONCE])
                slack = error * qn[r] * norms
                top = scan(tables[r % AT_ONCE], packed) + slack
                first = np.argpartition(-top, min(4 * k, len(top) - 1))[: 4 * k]
                sure = np.sort(x[first] @ q[r])[::-1]
                floor = sure[k] if len(sure) > k else -np.inf  # one more than k: the query itself may be among them
                near = np.flatnonzero(top >= floor) if np.isfinite(floor) else np.arange(len(top))
                near = np.union1d(near, first)
                score = (x[near] * q[r]).sum(1)
                best = near[np.lexsort((near, -score))][: k + 1]
                got = [(i, s) for c, s in zip(best, (x[best] * q[r]).sum(1), strict=True) for i in ids[c] if i != qid]
                got = sorted(got, key=lambda t: (-t[1], t[0]))[:k]
                rows.append((int(qid), [int(i) for i, _ in got], [float(s) for _, s in got]))
        return pd.DataFrame(rows, columns=["query_id", "ids", "scores"])

    met = asked.groupBy("block", "shard").cogroup(known.groupBy("block", "shard")).applyInPandas(meet, "query_id long, ids array<long>, scores array<double>")
    merged = met.groupBy("query_id").agg(F.flatten(F.collect_list(F.arrays_zip(F.transform("scores", lambda s: -s).alias("n"), F.col("ids").alias("i")))).alias("all"))
    best = merged.select("query_id", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("p", "x"))
    return best.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.n")).alias("score"))
