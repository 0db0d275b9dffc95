"""Links between 64-bit fingerprints at a small Hamming distance, by pigeonhole blocks.

Fingerprints are cut into six blocks. Two that differ in at most three bits agree on at least three whole
blocks, so they meet under one of the 20 keys made of three blocks (about 32 bits each). Keys held by
two fingerprints give their pair straight from the aggregation; those held by a few more are joined with
themselves; crowded keys are dealt again over 16 blocks of four bits, of which any close pair agrees on
13. Under such a key at most 2**12 different fingerprints exist, and it returns a spanning forest of
them, so that no group of any size is expanded into its pairs and no link is lost for its component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laminar.storage import stage

BROADCAST_ROWS = 20_000


def block_masks(blocks: int, same: int) -> list[int]:
    """Signed 64-bit masks of all choices of ``same`` out of ``blocks`` near-equal blocks."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    whole = [sum(parts[k] for k in chosen) for chosen in combinations(range(blocks), same)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in whole]


def with_keys(fps: DataFrame, blocks: int, same: int, fp: str = "fp") -> DataFrame:
    """``fps`` repeated under each of its keys: columns ``c`` (which blocks) and ``v`` (their bits) are added."""
    masks = block_masks(blocks, same)
    spread = fps.withColumn("__m", F.explode(F.expr("array(" + ",".join(f"struct({k} AS c, {m}L AS m)" for k, m in enumerate(masks)) + ")")))
    return spread.withColumns({"c": F.col("__m.c"), "v": F.col(fp).bitwiseAND(F.col("__m.m"))}).drop("__m")


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``rows``, counted before, is within the bound; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def spanning_forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Tree edges of the components that distance at most ``max_bits`` makes of different values."""
    values = values.astype(np.int64)
    bits = values.view(np.uint64)
    left = np.arange(len(values))
    out: list[tuple[int, int]] = []
    while len(left):
        wave, left = [left[0]], left[1:]
        while wave and len(left):
            node = wave.pop()
            near = np.bitwise_count(bits[left] ^ bits[node]) <= max_bits
            met = left[near]
            out.extend((int(values[node]), int(values[m])) for m in met)
            wave.extend(met)
            left = left[~near]
    return out


def hamming_links(fps: DataFrame, max_bits: int = 3, crowd: int = 64) -> DataFrame:
    """Edges ``(src, dst)`` whose components are those of all pairs at distance at most ``max_bits`` (3 or less).

    ``fps`` has one column ``fp`` of different longs and is read several times: stage it first.
    """
    if max_bits > 3:
        raise ValueError("the blocks find pairs of up to three differing bits")
    near = f"bit_count(src ^ dst) <= {max_bits}"
    keys = with_keys(fps, 6, 3)
    # almost all keys are held once: dealing the rows first spares a partial aggregation that merges nothing
    held = keys.repartition("c", "v").groupBy("c", "v").agg(F.count("*").alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst"))
    held = stage(held.where(f"n > 2 OR (n = 2 AND {near})"), "blocks")
    out = held.where("n = 2").select("src", "dst")
    counts = held.agg(F.count_if(F.expr(f"n > 2 AND n <= {crowd}")).alias("few"), F.count_if(F.col("n") > crowd).alias("many")).first()
    if counts["few"]:
        wanted = held.where(f"n > 2 AND n <= {crowd}").select("c", "v")
        members = keys.join(small(wanted, counts["few"]), ["c", "v"]).select("c", "v", "fp")
        pairs = members.withColumnRenamed("fp", "src").join(members.withColumnRenamed("fp", "dst"), ["c", "v"])
        out = out.union(pairs.where("src < dst").where(near).select("src", "dst"))
    if counts["many"]:
        wanted = held.where(f"n > {crowd}").select("c", "v")
        crowded = stage(keys.join(small(wanted, counts["many"]), ["c", "v"]).select("fp").distinct(), "crowded")

        @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])))
        def forest(groups: pd.Series) -> pd.Series:
            return groups.map(lambda g: [{"src": a, "dst": b} for a, b in spanning_forest(np.asarray(g), max_bits)])

        dealt = with_keys(crowded, 16, 13).groupBy("c", "v").agg(F.collect_list("fp").alias("g")).where(F.size("g") > 1)
        out = out.union(dealt.select(F.explode(forest("g")).alias("e")).select("e.src", "e.dst"))
    return out


def hamming_pairs(fps: DataFrame, max_bits: int = 3, crowd: int = 256) -> DataFrame:
    """All pairs ``(src, dst)``, ``src < dst``, at distance 1 to ``max_bits`` (3 or less), DataFrame functions only.

    ``fps`` has one column ``fp`` of different longs; stage it first. Crowded keys are dealt again over 32
    blocks of two bits, under whose keys at most 64 different fingerprints can stand. Pairs that meet under
    several keys come once.
    """
    near = f"bit_count(src ^ dst) <= {max_bits}"
    keys = with_keys(fps, 6, 3)
    # almost all keys are held once: dealing the rows first spares a partial aggregation that merges nothing
    held = keys.repartition("c", "v").groupBy("c", "v").agg(F.count("*").alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst"))
    held = stage(held.where(f"n > 2 OR (n = 2 AND {near})"), "blocks")
    out = held.where("n = 2").select("src", "dst")
    counts = held.agg(F.count_if(F.expr(f"n > 2 AND n <= {crowd}")).alias("few"), F.count_if(F.col("n") > crowd).alias("many")).first()

    def within(members: DataFrame) -> DataFrame:
        # a merge join: sizes are underestimated below an explode, and AQE splits a skewed merge join
        pairs = members.withColumnRenamed("fp", "src").hint("merge").join(members.withColumnRenamed("fp", "dst"), ["c", "v"])
        return pairs.where("src < dst").where(near).select("src", "dst")

    if counts["few"]:
        wanted = held.where(f"n > 2 AND n <= {crowd}").select("c", "v")
        out = out.union(within(stage(keys.join(small(wanted, counts["few"]), ["c", "v"]).select("c", "v", "fp"), "members")))
    if counts["many"]:
        wanted = held.where(f"n > {crowd}").select("c", "v")
        crowded = stage(keys.join(small(wanted, counts["many"]), ["c", "v"]).select("fp").distinct(), "crowded")
        out = out.union(within(with_keys(crowded, 32, 29)))
    return out.distinct()
