"""Masks and labels as sparse voxel tables: gating, size filters, neighbours, merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminar.functions.columns import packed
from laminar.graph import connected_components
from laminar.storage import stage

ZYX = ["z", "y", "x"]
VOXEL_BITS = 40


def gate(pred: DataFrame, ct: DataFrame) -> DataFrame:
    """Predicted voxels inside the scanned object: an equi-join on the voxel, filters first."""
    return pred.where("pred > 0").join(ct.where("ct > 0"), ["slab", *ZYX])


def voxel_key(z, y, x, ny: int, nx: int):
    return (z * ny + y) * nx + x


def voxel_components(mask: DataFrame, ny: int, nx: int) -> DataFrame:
    """``slab, z, y, x, component``: face-connected components of a mask, one grid per slab.

    Neighbours along an axis are consecutive voxels of a line, found with ``lead`` rather than a join. The voxels of a run along x are
    one node, named by its first voxel, so that the rounds see runs and the contacts between them once, not voxels.
    """
    base = mask.select("slab", *ZYX).distinct()
    base = base.withColumn("n", packed([(F.col("slab"), 63 - VOXEL_BITS), (voxel_key(F.col("z"), F.col("y"), F.col("x"), ny, nx), VOXEL_BITS)]))
    row = Window.partitionBy("slab", "z", "y").orderBy("x")
    starts = F.when(F.coalesce(F.lag("x").over(row) == F.col("x") - 1, F.lit(False)), None).otherwise(F.col("n"))
    runs = base.withColumn("start", starts).withColumn("run", F.last("start", ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("start", "n")
    runs = stage(runs, "runs")
    edges = None
    for axis in ("z", "y"):
        others = [c for c in ZYX if c != axis]
        along = Window.partitionBy("slab", *others).orderBy(axis)
        step = runs.withColumn("to", F.when(F.lead(axis).over(along) == F.col(axis) + 1, F.lead("run").over(along))).where("to IS NOT NULL").select(F.col("run").alias("src"), F.col("to").alias("dst"))
        edges = step if edges is None else edges.union(step)
    found = connected_components(edges)
    return runs.join(found.withColumnRenamed("node", "run"), "run", "left").select("slab", *ZYX, F.coalesce("component", "run").alias("component"))


def size_filter(labelled: DataFrame, label: list[str], least: int) -> DataFrame:
    """Rows of labels with at least ``least`` rows: counts first, then a semi join."""
    big = labelled.groupBy(*label).count().where(F.col("count") >= least).select(*label)
    return labelled.join(big, label, "left_semi")


def cleaning_report(voxels: DataFrame, ny: int, nx: int, least: int) -> DataFrame:
    """``slab, raw, gated, components, kept, cleaned, pct_removed`` from ``slab, z, y, x, pred, ct``: predicted voxels, those inside the object,
    their face-connected components, those of ``least`` voxels or more, and the voxels that are left in them."""
    raw, inside = F.col("pred") > 0, (F.col("pred") > 0) & (F.col("ct") > 0)
    counts = voxels.groupBy("slab").agg(F.count_if(raw).alias("raw"), F.count_if(inside).alias("gated"))
    sizes = voxel_components(voxels.where(inside), ny, nx).groupBy("slab", "component").agg(F.count("*").alias("n"))
    big = F.col("n") >= least
    kept = sizes.groupBy("slab").agg(F.count("*").alias("components"), F.count_if(big).alias("kept"), F.sum(F.when(big, F.col("n")).otherwise(0)).alias("cleaned"))
    out = counts.join(kept, "slab", "left").select("slab", "raw", "gated", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("components", "kept", "cleaned")])
    return out.withColumn("pct_removed", F.round(100.0 * (F.col("raw") - F.col("cleaned")) / F.col("raw"), 6))


def rest_components(mask: DataFrame, seeded: DataFrame, ny: int, nx: int) -> DataFrame:
    """``slab, z, y, x, component``: the components of the mask voxels that no seed reached (those of ``seeded`` taken away)."""
    return voxel_components(mask.join(seeded.select("slab", *ZYX), ["slab", *ZYX], "left_anti"), ny, nx)


def mega_labels(labelled: DataFrame, label: str, share: float) -> DataFrame:
    """Labels that hold at least ``share`` of all labelled rows: ``label, n, share``."""
    sizes = labelled.groupBy(label).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).where(F.col("n") >= share * F.col("total")).select(label, "n", (F.col("n") / F.col("total")).alias("share"))


def boundary_pairs(labelled: DataFrame) -> DataFrame:
    """``slab, a, b, n, mean_depth``: face contacts between labels, counted once, with their mean smaller depth."""
    parts = None
    for axis in ZYX:
        others = [c for c in ZYX if c != axis]
        along = Window.partitionBy("slab", *others).orderBy(axis)
        next_to = F.lead(axis).over(along) == F.col(axis) + 1
        pair = labelled.select("slab", F.col("label").alias("p"), F.when(next_to, F.lead("label").over(along)).alias("q"), "depth", F.lead("depth").over(along).alias("depth2")).where("q IS NOT NULL AND p != q")
        parts = pair if parts is None else parts.union(pair)
    return parts.groupBy("slab", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.count("*").alias("n"), F.avg(F.least("depth", "depth2")).alias("mean_depth"))


def eligible_merges(pairs: DataFrame, sizes: DataFrame, low: int = 20, high: int = 60, share: float = 0.75) -> DataFrame:
    """Pairs whose border is neither thin nor broad and about as deep as the thinner of the two."""
    a = sizes.select("slab", F.col("label").alias("a"), F.col("n").alias("n_a"), F.col("p90").alias("p90_a"))
    b = sizes.select("slab", F.col("label").alias("b"), F.col("n").alias("n_b"), F.col("p90").alias("p90_b"))
    both = pairs.where(F.col("n").between(low, high)).join(a, ["slab", "a"]).join(b, ["slab", "b"])
    return both.where(F.col("mean_depth") >= share * F.least("p90_a", "p90_b"))


def capped_merge(eligible: DataFrame, sizes: DataFrame, cap: float = 0.15) -> DataFrame:
    """``slab, label, merged``: unions in the order of depth, refused where they reach ``cap`` of the slab.

    The order decides, so a slab's pair table (labels, not voxels) is one group.
    """

    def one(pairs: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        size = dict(zip(nodes["label"], nodes["n"], strict=True))
        limit = cap * sum(size.values())
        parent = {k: k for k in size}

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for r in pairs.sort_values(["mean_depth", "a", "b"], ascending=[False, True, True]).itertuples():
            a, b = sorted((root(r.a), root(r.b)))
            if a != b and size[a] + size[b] < limit:
                parent[b] = a
                size[a] += size[b]
        return pd.DataFrame({"slab": nodes["slab"], "label": nodes["label"], "merged": [root(k) for k in nodes["label"]]})

    pairs = eligible.select(F.col("slab").alias("of"), "a", "b", "mean_depth")
    return pairs.groupBy("of").cogroup(sizes.select("slab", "label", "n").groupBy("slab")).applyInPandas(one, "slab long, label long, merged long")


def label_stats(labelled: DataFrame) -> DataFrame:
    """``slab, label, n, p90``: voxels and 90th percentile of depth per label."""
    return labelled.groupBy("slab", "label").agg(F.count("*").alias("n"), F.percentile("depth", F.lit(0.9)).alias("p90"))


def interior(mask: DataFrame, ny: int, nx: int, nz: int) -> DataFrame:
    """Voxels whose whole 3x3x3 neighbourhood inside the grid is in the mask.

    Three passes of row windows, one an axis: a voxel survives when its neighbours on that line do.
    """
    out = mask.select("slab", *ZYX).withColumn("ok", F.lit(1))
    for axis, most in zip(ZYX, (nz, ny, nx), strict=True):
        others = [c for c in ZYX if c != axis]
        along = Window.partitionBy("slab", *others).orderBy(axis)
        before = F.when(F.col(axis) == 0, 1).when(F.lag(axis).over(along) == F.col(axis) - 1, F.lag("ok").over(along)).otherwise(0)
        after = F.when(F.col(axis) == most - 1, 1).when(F.lead(axis).over(along) == F.col(axis) + 1, F.lead("ok").over(along)).otherwise(0)
        out = out.withColumn("now", F.least("ok", before, after)).withColumn("ok", F.col("now")).drop("now")
    return out.where("ok = 1").select("slab", *ZYX)


def thickness(sizes: DataFrame, lines: DataFrame, top: int = 5) -> DataFrame:
    """Volume over centre-line length of the ``top`` largest labels: ``label, n, length, proxy``."""
    both = sizes.join(lines, "label").withColumn("proxy", F.col("n") / F.col("length"))
    return both.orderBy(F.desc("n"), "label").limit(top).select("label", "n", "length", "proxy")
