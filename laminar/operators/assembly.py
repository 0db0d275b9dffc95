"""Tiled slabs to one volume: bands of neighbouring tiles, ids of a slab, bands of neighbouring slabs, ids of the whole.

Labels are rows ``slab, ty, tx, z, y, x, label`` with positive labels, ``slab`` being the slab's first z and z, y, x global.
Tiles of one slab overlap, slabs overlap in z, so a voxel stands under up to four tiles of up to two slabs. Bands are keyed:
every row of a band is repeated under the key of each neighbour that covers it, once as the earlier and once as the later
side, and one aggregation by key and place pairs the two labels. No side is broadcast, no rows are compared otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminar.functions.columns import packed
from laminar.graph import connected_components
from laminar.operators.stitch import all_links, dense_ids

TILE_BITS, LABEL_BITS, GID_BITS = 10, 24, 40


def tile_node(slab, ty, tx, label) -> Column:
    """One long for a label of a tile, in the order of slab, tile and label."""
    return packed([(slab, 63 - 2 * TILE_BITS - LABEL_BITS), (ty, TILE_BITS), (tx, TILE_BITS), (label, LABEL_BITS)])


def slab_node(slab, gid) -> Column:
    """One long for an instance of a slab: the slab's offset and the id within it."""
    return packed([(slab, 63 - GID_BITS), (gid, GID_BITS)])


def _paired(keyed: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, a, b, n`` from rows that are the earlier (``late`` false) or later side of a band at z, y, x."""
    side = lambda late: F.max(F.when(F.col("late") == late, F.col(value)))
    both = keyed.groupBy(*by, "z", "y", "x").agg(side(False).alias("a"), side(True).alias("b"))
    return both.where("a IS NOT NULL AND b IS NOT NULL").groupBy(*by, "a", "b").agg(F.count("*").alias("n"))


def tile_band_votes(labels: DataFrame, tile: int, stride: int) -> DataFrame:
    """``slab, ty, tx, band, a, b, n``: voxels of the band that a tile shares with its ``left`` or ``top`` neighbour, by the
    neighbour's label a and its own label b. Diagonal neighbours are not paired. A tile that repeats a voxel counts it once
    (largest label); rows without a positive label are ignored."""
    overlap = tile - stride
    y, x, ty, tx = (F.col(c) for c in ("y", "x", "ty", "tx"))
    key = lambda side, late, ky, kx: F.struct(F.lit(side == "top").alias("top"), F.lit(late).alias("late"), ky.cast("long").alias("ky"), kx.cast("long").alias("kx"))
    keys = [
        (x >= (tx + 1) * stride, key("left", False, ty, tx + 1)),
        (y >= (ty + 1) * stride, key("top", False, ty + 1, tx)),
        ((tx > 0) & (x < tx * stride + overlap), key("left", True, ty, tx)),
        ((ty > 0) & (y < ty * stride + overlap), key("top", True, ty, tx)),
    ]
    held = F.explode(F.array_compact(F.array(*[F.when(fits, k) for fits, k in keys])))
    keyed = labels.where("label > 0").select("slab", held.alias("k"), "z", "y", "x", "label")
    keyed = keyed.select("slab", F.col("k.ky").alias("ty"), F.col("k.kx").alias("tx"), "k.top", "k.late", "z", "y", "x", "label")
    return _paired(keyed, ["slab", "ty", "tx", "top"], "label").select("slab", "ty", "tx", F.when(F.col("top"), "top").otherwise("left").alias("band"), "a", "b", "n")


def slab_instances(labels: DataFrame, votes: DataFrame, least: int = 20, share: float = 0.7) -> DataFrame:
    """``slab, ty, tx, label, gid``: ids within each slab, from 1, in the order in which tiles and labels come first.

    ``votes`` are those of ``tile_band_votes``; labels without a link are instances of their own.
    """
    before = F.when(F.col("band") == "left", F.struct(F.col("ty"), (F.col("tx") - 1).alias("tx"))).otherwise(F.struct((F.col("ty") - 1).alias("ty"), F.col("tx")))
    links = all_links(votes, least, share, ("slab", "ty", "tx", "band")).withColumn("p", before)
    edges = links.select(tile_node(F.col("slab"), F.col("p.ty"), F.col("p.tx"), F.col("a")).alias("src"), tile_node(F.col("slab"), F.col("ty"), F.col("tx"), F.col("b")).alias("dst"))
    nodes = labels.where("label > 0").select("slab", "ty", "tx", "label").distinct()
    nodes = nodes.withColumn("node", tile_node(F.col("slab"), F.col("ty"), F.col("tx"), F.col("label")))
    placed = nodes.join(connected_components(edges), "node", "left").withColumn("root", F.coalesce("component", "node"))
    # a row an instance, ordered within its slab; the root is its first label
    ids = placed.select("slab", "root").distinct().withColumn("gid", F.row_number().over(Window.partitionBy("slab").orderBy("root")).cast("long"))
    return placed.join(ids, ["slab", "root"]).select("slab", "ty", "tx", "label", "gid")


def slab_band_votes(labels: DataFrame, instances: DataFrame, depth: int, overlap: int) -> DataFrame:
    """``zb, ty, tx, a, b, n``: voxels in the last ``overlap`` planes of a slab and the first of the one that starts there, tile
    by tile of the same place, by the slab ids on either side. Slabs that do not meet so share no key and give no rows.

    Voxels are counted by the labels on either side, and only these counts meet the ids. A tile that repeats a voxel counts it once
    (largest label)."""
    start = F.col("slab") + depth - overlap
    sides = [F.when(F.col("z") >= start, F.struct(start.alias("zb"), F.lit(False).alias("late"))), F.when(F.col("z") < F.col("slab") + overlap, F.struct(F.col("slab").alias("zb"), F.lit(True).alias("late")))]
    keyed = labels.where("label > 0").select(F.explode(F.array_compact(F.array(*sides))).alias("k"), "ty", "tx", "z", "y", "x", "label").select("k.zb", "k.late", "ty", "tx", "z", "y", "x", "label")
    counts = _paired(keyed, ["zb", "ty", "tx"], "label")
    early, late = (instances.select(zb.cast("long").alias("zb"), "ty", "tx", F.col("label").alias(side), F.col("gid").alias(f"g{side}")) for side, zb in (("a", start), ("b", F.col("slab"))))
    placed = counts.join(early, ["zb", "ty", "tx", "a"]).join(late, ["zb", "ty", "tx", "b"])
    return placed.groupBy("zb", "ty", "tx", F.col("ga").alias("a"), F.col("gb").alias("b")).agg(F.sum("n").alias("n"))


def slab_links(votes: DataFrame, step: int, least: int = 20, share: float = 0.7) -> DataFrame:
    """``zb, src, dst``: linked instances of neighbouring slabs as nodes; ``step`` is the distance of slab starts."""
    links = all_links(votes, least, share, ("zb", "ty", "tx")).select("zb", "a", "b").distinct()
    return links.select("zb", slab_node(F.col("zb") - step, F.col("a")).alias("src"), slab_node(F.col("zb"), F.col("b")).alias("dst"))


def slab_nodes(instances: DataFrame) -> DataFrame:
    """``node``: the instances of all slabs."""
    return instances.select("slab", "gid").distinct().select(slab_node(F.col("slab"), F.col("gid")).alias("node"))


def band_agreement(votes: DataFrame, links: DataFrame, components: DataFrame, step: int) -> DataFrame:
    """``za, zb, links, n_voxels, n_agree, rate`` per pair of slabs, on the final ``components`` (``node, component``)."""
    nodes = votes.select("zb", slab_node(F.col("zb") - step, F.col("a")).alias("na"), slab_node(F.col("zb"), F.col("b")).alias("nb"), "n")
    a, b = (components.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("na", "ca"), ("nb", "cb")))
    both = nodes.groupBy("zb", "na", "nb").agg(F.sum("n").alias("n")).join(a, "na").join(b, "nb")
    out = both.groupBy("zb").agg(F.sum("n").alias("n_voxels"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("n")).otherwise(0)).alias("n_agree"))
    out = out.join(links.groupBy("zb").agg(F.count("*").alias("links")), "zb", "left")
    return out.select((F.col("zb") - step).alias("za"), "zb", F.coalesce("links", F.lit(0)).alias("links"), "n_voxels", "n_agree", (F.col("n_agree") / F.col("n_voxels")).alias("rate"))


def whole_ids(instances: DataFrame, components: DataFrame) -> DataFrame:
    """``slab, ty, tx, label, id``: ids of the whole volume, from 1, in the order in which slabs and their instances come first."""
    ids = dense_ids(components.select("component"), "component")
    placed = instances.withColumn("node", slab_node(F.col("slab"), F.col("gid"))).join(components, "node").join(ids, "component")
    return placed.select("slab", "ty", "tx", "label", "id")
