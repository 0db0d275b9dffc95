"""Connected components as DataFrame rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from laminar.session import ship
from laminar.storage import discard, stage

FOREST = 500_000  # edges that a task goes through together


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge: columns ``node``, ``component`` (its smallest node).

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each a few aggregations and
    equi-joins; the number of rounds grows with the logarithm of the longest chain. Each round is staged
    in the shared folder and the one before is removed, so that disk holds two rounds at most. A node
    with very many neighbours is one side of an equi-join on unique keys, which AQE splits when skewed.
    Self loops and nulls are ignored; an empty edge table gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    now = stage(pairs.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("p")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.select(F.col("v").alias("u"), F.col("p").alias("w")).union(now.select("p", "v"))
        low = both.groupBy("u").agg(F.min("w").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("w > u").select(F.col("w").alias("v"), F.col("m").alias("p")).distinct()
        least = large.groupBy("v").agg(F.min("p").alias("m"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array(F.struct("p", "m"), F.struct(F.col("v").alias("p"), "m"))).alias("e"))
            .select(F.col("e.p").alias("v"), F.col("e.m").alias("p"))
            .where("v != p")
            .distinct()
        )
        after = stage(small, "edges")
        before, now = now, after
        new_mark = _mark(now)
        discard(before)
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct()
    return now.select(F.col("v").alias("node"), F.col("p").alias("component")).union(roots)


def offset_components(edges: DataFrame, src: str = "src", dst: str = "dst", delta: str = "delta", order: str = "pos", max_rounds: int = 40) -> DataFrame:
    """Components with potentials: ``node, component, offset`` along edges that say how much more ``dst`` has than ``src``.

    ``component`` is the smallest node and ``offset`` a node's potential above it, along the tree of edges that come first in
    ``order`` (ties by src, dst, delta): the tree that takes edges in that order and passes over those whose ends it has joined.
    Each task first leaves out edges that close a circle of its own. Rounds of joins (Boruvka): every component picks its first edge, picks are followed to a root by doubling, edges between the
    same two components are kept once. Sums are carried along, so no component is ever one group. Self loops and nulls are ignored.
    """
    a, b = F.col(src), F.col(dst)
    given = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("s"), b.alias("t"), F.col(delta).cast("long").alias("d"), F.col(order).alias("o"))
    if all(isinstance(given.schema[c].dataType, IntegralType) for c in "sto"):
        ship(edges.sparkSession)
        longs = given.select(*[F.col(c).cast("long").alias(c) for c in "stdo"])
        given = longs.mapInPandas(_first_trees, "s long, t long, d long, o long").select(*[F.col(c).cast(given.schema[c].dataType).alias(c) for c in "stdo"])
    first = given.groupBy(F.least("s", "t").alias("u"), F.greatest("s", "t").alias("v")).agg(F.min(F.struct("o", "s", "t", "d")).alias("f"))
    now = stage(first.select("u", "v", F.when(F.col("f.s") == F.col("u"), F.col("f.d")).otherwise(-F.col("f.d")).alias("d"), F.struct("f.o", "f.s", "f.t").alias("o")), "offsetedges")
    at = stage(now.select(F.col("u").alias("node")).union(now.select("v")).distinct().select("node", F.col("node").alias("component"), F.lit(0).cast("long").alias("off")), "offsets")
    for _ in range(max_rounds):
        if not now.head(1):
            break
        ends = now.select(F.col("u").alias("c"), F.col("v").alias("to"), F.col("d").alias("up"), "o").union(now.select("v", "u", -F.col("d"), "o"))
        picks = stage(ends.groupBy("c").agg(F.min(F.struct("o", "to", "up")).alias("p")).select("c", "p.to", "p.up"), "picks")
        back = picks.select(F.col("c").alias("to"), F.col("to").alias("c"), F.lit(True).alias("mutual"))
        root = F.coalesce("mutual", F.lit(False)) & (F.col("c") < F.col("to"))
        tree = picks.join(back, ["c", "to"], "left").select("c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("p"), F.when(root, 0).otherwise(-F.col("up")).cast("long").alias("off"))
        tree = _to_roots(stage(tree, "tree"), max_rounds)
        one, two = (tree.select(F.col("c").alias(c), F.col("p").alias(f"p{c}"), F.col("off").alias(f"o{c}")) for c in "uv")
        moved = now.join(one, "u").join(two, "v").where("pu != pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"), (F.col("d") - F.col("ov") + F.col("ou")).alias("d"), "o")
        after, before = stage(_between(moved), "offsetedges"), now
        went = tree.select(F.col("c").alias("component"), "p", F.col("off").alias("more"))
        settled = stage(at.join(went, "component", "left").select("node", F.coalesce("p", "component").alias("component"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off")), "offsets")
        discard(before, at, picks, tree)
        now, at = after, settled
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    low = at.groupBy("component").agg(F.min("node").alias("low"), F.min_by("off", "node").alias("base"))
    return at.join(low, "component").select("node", F.col("low").alias("component"), (F.col("off") - F.col("base")).alias("offset"))


def _between(edges: DataFrame) -> DataFrame:
    """The first edge in order between each two nodes, from the smaller one."""
    turn = F.col("u") > F.col("v")
    flat = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.when(turn, -F.col("d")).otherwise(F.col("d")).alias("d"), "o")
    return flat.groupBy("u", "v").agg(F.min(F.struct("o", "d")).alias("f")).select("u", "v", "f.d", "f.o")


def _first_trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges ``s, t, d, o`` of a task without those that close a circle of edges before them in the order of o, s, t, d: no tree that
    is built in this order takes them, whatever the edges of other tasks. Edges with a null are handed on."""

    def trees(e: np.ndarray) -> np.ndarray:
        e = e[np.lexsort((e[:, 2], e[:, 1], e[:, 0], e[:, 3]))]
        nodes, ends = np.unique(e[:, :2], return_inverse=True)
        above = list(range(len(nodes)))
        keep = []
        for k, (a, b) in enumerate(ends.reshape(-1, 2).tolist()):
            while above[a] != a:
                above[a] = a = above[above[a]]
            while above[b] != b:
                above[b] = b = above[above[b]]
            if a != b:
                above[max(a, b)] = min(a, b)
                keep.append(k)
        return e[keep]

    def frame(e: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(e, columns=list("stdo"))

    held, n = [], 0
    for batch in batches:
        odd = batch["d"].isna() | batch["o"].isna()
        if odd.any():
            yield batch[odd]
            batch = batch[~odd]
        held.append(batch[list("stdo")].to_numpy(dtype=np.int64))
        n += len(batch)
        if n >= FOREST:
            kept = trees(np.concatenate(held))
            if len(kept) > FOREST // 2:
                yield frame(kept)
                kept = kept[:0]
            held, n = [kept], len(kept)
    if n:
        yield frame(trees(np.concatenate(held)))


def _to_roots(tree: DataFrame, max_rounds: int) -> DataFrame:
    """``c, p, off`` with every pointer led to its root, doubling the steps each time."""
    for _ in range(max_rounds):
        up = tree.select(F.col("c").alias("p"), F.col("p").alias("q"), F.col("off").alias("more"))
        step = stage(tree.join(up, "p").select("c", F.col("q").alias("p"), (F.col("off") + F.col("more")).alias("off"), (F.col("q") != F.col("p")).alias("moved")), "tree")
        discard(tree)
        tree = step.drop("moved")
        if not step.where("moved").head(1):
            return tree
    raise RuntimeError(f"pointers did not settle in {max_rounds} rounds")


def conflicts(edges: DataFrame, placed: DataFrame, src: str = "src", dst: str = "dst", delta: str = "delta") -> DataFrame:
    """``edges`` with ``component`` and ``conflict``: whether the offsets of ``placed`` (see ``offset_components``) say otherwise."""
    one = placed.select(F.col("node").alias(src), "component", F.col("offset").alias("__a"))
    two = placed.select(F.col("node").alias(dst), F.col("offset").alias("__b"))
    both = edges.join(one, src).join(two, dst)
    return both.withColumn("conflict", F.col("__b") - F.col("__a") != F.col(delta)).drop("__a", "__b")


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    row = edges.agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(v, p))").alias("x"), F.sum(F.expr("xxhash64(p, v) % 1000003")).alias("s")
    ).first()
    return (row["n"], row["x"], row["s"])
