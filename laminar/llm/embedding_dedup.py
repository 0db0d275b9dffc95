"""Operator 3: embedding near-duplicates over an inverted multi-index.

The unit vectors are cut in halves, each with a codebook of its own; the product of the two codebooks is
the grid of cells. Every vector is listed in its cell, and visits the cells nearest to it in the order of
the multi-sequence (sum of the two half distances) until the visited cells reach the target recall,
which is calibrated on a bounded sample with partners at exactly the linking cosine. Cells of the same first word stand on
one shelf, and shelves of neighbouring words in one bay of some thousand vectors, so that a vector is sent once to every bay that
it visits, not to every shelf; all that a visited bay holds is then verified in double precision, and every link that holds is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from laminar.graph import connected_components
from laminar.llm.vectors import kmeans, matrix, nearest, sample, squared, valid_vectors
from laminar.storage import stage

SAMPLE = 20_000
BLOCK, LARGEST = 1024, 16_384  # vectors of a block, least and most
CELLS = 1 << 22  # of a matrix of cosines


def codebook_size(n: int) -> int:
    """Words per half codebook for ``n`` vectors: about eight vectors a cell, 2,048 words at most."""
    return int(min(2048, max(4, 2 ** round(np.log2(max(n, 1) / 8) / 2))))


def visit_order(d1: np.ndarray, d2: np.ndarray, cells: int) -> np.ndarray:
    """The ``cells`` grid cells of smallest ``d1 + d2`` for each row, as ``i * len(second) + j``, nearest first.

    The multi-sequence over two sorted lists: a cell at ranks (a, b) is behind ``(a+1)*(b+1) - 1`` others,
    so only ranks with ``(a+1)*(b+1) <= cells`` can be among the nearest.
    """
    k1, k2 = d1.shape[1], d2.shape[1]
    o1, o2 = np.argsort(d1, 1, kind="stable"), np.argsort(d2, 1, kind="stable")
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    ab = np.array([(a, b) for a in range(min(k1, cells)) for b in range(min(k2, cells // (a + 1)))])
    total = s1[:, ab[:, 0]] + s2[:, ab[:, 1]]
    best = np.argsort(total, 1, kind="stable")[:, :cells]
    return np.take_along_axis(o1[:, ab[:, 0]], best, 1) * k2 + np.take_along_axis(o2[:, ab[:, 1]], best, 1)


class MultiIndex:
    """Two half codebooks and the number of cells to visit."""

    def __init__(self, x: np.ndarray, k: int, cosine: float, recall: float, seed: int = 11) -> None:
        self.half = x.shape[1] // 2
        self.first, self.second = kmeans(x[:, : self.half], k), kmeans(x[:, self.half :], k)
        self.visits = self._calibrate(x, cosine, recall, seed)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.first), squared(x[:, self.half :], self.second)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.first) * len(self.second) + nearest(x[:, self.half :], self.second)

    def visit(self, x: np.ndarray) -> np.ndarray:
        return visit_order(*self.distances(x), self.visits)

    def _calibrate(self, x: np.ndarray, cosine: float, recall: float, seed: int) -> int:
        """Cells to visit until ``recall`` of partners at exactly ``cosine`` are reached."""
        rng = np.random.default_rng(seed)
        q = x[rng.permutation(len(x))[:500]]
        away = rng.standard_normal(q.shape)
        away -= (away * q).sum(1, keepdims=True) * q
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        partner = cosine * q + np.sqrt(1 - cosine * cosine) * away
        d1, d2 = self.distances(q)
        total = d1[:, :, None] + d2[:, None, :]
        cell = self.cell(partner)
        own = total.reshape(len(q), -1)[np.arange(len(q)), cell]
        rank = np.array([(t < o).sum() + 1 for t, o in zip(total.reshape(len(q), -1), own, strict=True)])
        return int(np.quantile(rank, recall))


def bays(words: np.ndarray, held: np.ndarray, n_bays: int) -> list[int]:
    """The bay of each shelf: shelves in the order of their codewords along the main axis, cut into bays of like numbers of vectors."""
    away = words - words.mean(0)
    order = np.argsort(away @ np.linalg.svd(away, full_matrices=False)[2][0], kind="stable")
    middle = np.cumsum(held[order]) - held[order] / 2
    out = np.empty(len(words), dtype=np.int64)
    out[order] = np.minimum(middle * n_bays // max(1, held.sum()), n_bays - 1)
    return out.tolist()


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _forest(link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Edges that keep the components of a bipartite link matrix: at most one per row and column."""
    out, row_left, col_left = [], np.ones(len(rows), bool), np.ones(len(cols), bool)
    row_left &= link.any(1)
    col_left &= link.any(0)
    while row_left.any():
        wave = [int(np.argmax(row_left))]
        row_left[wave[0]] = False
        while wave:
            r = wave.pop()
            met = np.flatnonzero(link[r] & col_left)
            col_left[met] = False
            out.extend((int(rows[r]), int(cols[c])) for c in met)
            if len(met):
                more = link[:, met].any(1) & row_left
                for r2 in np.flatnonzero(more):
                    out.append((int(rows[r2]), int(cols[met[np.argmax(link[r2, met])]])))
                row_left[more] = False
                wave.extend(np.flatnonzero(more).tolist())
    return [(a, b) for a, b in out if a != b]


def near_duplicate_vectors(
    table: DataFrame, cosine: float = 0.9, recall: float = 0.995, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = SAMPLE
) -> DataFrame:
    """One row per vector: ``(vec_id, n_links, component_id, kept)``.

    Vectors link at a cosine of ``cosine`` or more; ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable, ``kept`` marks that row. Null, zero, empty and
    non-finite vectors link with nothing and are their own component. Equal vectors are one class, searched
    once and counted by its size; a pair that either side's visits reach counts for both. Vectors of other than the most common length take no part in linking.
    Rows that repeat an id are one row (of the smallest vector); null ids are left out. A bay is
    dealt into blocks of members, its seekers too, and each pair of blocks returns counts and a spanning
    forest, never its pairs. A block has a sixth of all vectors, ``BLOCK`` at least and about ``LARGEST`` at most, so that n vectors are sent
    n / 8,192 times each at most. The codebooks are fit on the ``sample_rows`` vectors of smallest hash.
    """
    ids = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    good = valid_vectors(table, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    good = stage(good, "vectors")
    shape = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = ids.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if shape is None or shape["d"] < 2:
        return empty
    good = good.where(F.size("v") == shape["d"])
    classes = stage(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "classes")
    n = classes.count()
    k = codebook_size(n)
    index = MultiIndex(_unit(sample(classes, sample_rows)), k, cosine, recall)
    n_second = len(index.second)
    kind = np.float32 if table.schema[vec_col].dataType.elementType == FloatType() else np.float64  # as given: doubles are twice as long

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                given = matrix(part["v"])
                unit = _unit(given)
                shelves = [np.unique(c // n_second).tolist() for c in index.visit(unit)]
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "m": part["m"].to_numpy(), "u": [u.tobytes() for u in given.astype(kind)], "shelf": index.cell(unit) // n_second, "shelves": shelves})

    listed = stage(classes.mapInPandas(lists, "rep long, m long, u binary, shelf long, shelves array<long>"), "listed")
    block = min(LARGEST, max(BLOCK, -(-n // 6)))
    n_bays = -(-n // block)
    held = np.zeros(len(index.first))
    for r in listed.groupBy("shelf").count().collect():  # one row per codeword: 2,048 at most
        held[r["shelf"]] = r["count"]
    bay = F.lit(bays(index.first, held, n_bays))
    at = lambda values, k: F.get(values, k.cast("int"))
    listed = listed.select("rep", "m", "u", at(bay, F.col("shelf")).alias("own"), F.array_distinct(F.transform("shelves", lambda k: at(bay, k))).alias("bays"))
    crowd, asking = [1] * n_bays, [1] * n_bays
    for r in listed.groupBy("own").count().collect():
        crowd[r["own"]] = max(1, round(r["count"] / block))
    for r in listed.select(F.explode("bays").alias("bay")).groupBy("bay").count().collect():
        asking[r["bay"]] = max(1, round(r["count"] / block))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    one_of = lambda sizes, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), at(F.lit(sizes), F.col("bay"))).cast("long")
    # a bay is dealt into blocks of members by blocks of seekers, so that no group grows with it
    members = listed.withColumn("bay", F.col("own")).withColumn("block", one_of(crowd, 0))
    members = members.select("bay", "block", every(at(F.lit(asking), F.col("bay"))).alias("part"), F.lit(0).alias("asks"), "rep", "m", "u", "own", "bays")
    seekers = listed.withColumn("bay", F.explode("bays")).withColumn("part", one_of(asking, 1))
    seekers = seekers.select("bay", every(at(F.lit(crowd), F.col("bay"))).alias("block"), "part", F.lit(1).alias("asks"), "rep", "m", "u", "own", F.array().cast("array<bigint>").alias("bays"))
    both = members.unionByName(seekers)

    def units(column: pd.Series) -> np.ndarray:
        return _unit(np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1).astype(np.float64))

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        known, asks = group[group["asks"] == 0], group[group["asks"] == 1]
        rows, counts, edges = [], [], []
        if len(known) and len(asks):
            known = known.sort_values("rep")
            mu = units(known["u"])
            ids_, m = known["rep"].to_numpy(), known["m"].to_numpy()
            visited = np.zeros((len(known), n_bays), dtype=bool)
            for k, b in enumerate(known["bays"]):
                visited[k, b] = True
            step = max(1, CELLS // len(known))
            for start in range(0, len(asks), step):
                q = asks.iloc[start : start + step]
                q_ids, q_own, q_m = q["rep"].to_numpy(), q["own"].to_numpy(), q["m"].to_numpy()
                link = units(q["u"]) @ mu.T >= cosine
                link &= q_ids[:, None] != ids_[None, :]
                met = np.flatnonzero(link.any(0))
                alone = link[:, met] & ~visited[met][:, q_own].T  # the member does not come by these seekers' bay itself
                for who, found in ((q_ids, link @ m), (ids_[met], q_m @ alone)):
                    hit = np.flatnonzero(found)
                    rows.extend(who[hit].tolist())
                    counts.extend(found[hit].tolist())
                edges.extend(_forest(link, q_ids, ids_))
        seen = [(a, c, None) for a, c in zip(rows, counts, strict=True)] + [(a, None, b) for a, b in edges]
        return pd.DataFrame(seen, columns=["rep", "found", "other"]).astype({"rep": "int64", "found": "Int64", "other": "Int64"})

    found = stage(both.groupBy("bay", "block", "part").applyInPandas(verify, "rep long, found long, other long"), "found")
    links = found.where("found IS NOT NULL").groupBy("rep").agg(F.sum("found").alias("far"))
    comps = connected_components(found.where("other IS NOT NULL").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    per_class = classes.join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("v", (F.coalesce("far", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.join(per_class, "v").select("id", "n_links", "component_id")
    full = ids.join(out, "id", "left")
    return full.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("component_id", "id") == F.col("id")).alias("kept")
    )
