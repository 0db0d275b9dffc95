"""Instances across tiles and slabs: votes, links, components, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminar.graph import connected_components


def tile_grid(ny: int, nx: int, tile: int, stride: int, least: int) -> str:
    """SQL for the tile origins and clipped sizes of a grid (``y0, x0, ny, nx``)."""
    return f"""SELECT y0, x0, least({tile}, {ny} - y0) AS ny, least({tile}, {nx} - x0) AS nx
      FROM (SELECT explode(sequence(0, {ny} - {least}, {stride})) AS y0) CROSS JOIN (SELECT explode(sequence(0, {nx} - {least}, {stride})) AS x0)"""


def covering_tiles(points: DataFrame, tile: int, stride: int, tiles: int) -> DataFrame:
    """Each point under the one or two tile indices per axis whose span holds it; ``own`` marks the owner.

    Keys are made by arithmetic, so that the interval lookup is an equi-join.
    """
    out = points
    for axis in ("y", "x"):
        k = F.floor(F.col(axis) / stride).cast("long")
        at = F.col(axis)
        options = F.filter(F.array(k, k - 1), lambda t: (t >= 0) & (t < tiles) & (at < t * stride + tile))  # noqa: B023
        out = out.withColumn(f"t{axis}", F.explode(options))
    overlap = tile - stride
    own = ((F.col("ty") == 0) | (F.col("y") - F.col("ty") * stride >= overlap / 2)) & ((F.col("tx") == 0) | (F.col("x") - F.col("tx") * stride >= overlap / 2))
    return out.withColumn("own", own)


def compose_canvas(labels: DataFrame, trim: int) -> DataFrame:
    """``slab, y, x, gid`` from tile labels ``slab, ty, tx, yl, xl, y, x, gid``: a tile gives up its first
    ``trim`` rows (columns) where the tile before exists, and later tiles overwrite earlier ones."""
    tiles = labels.select("slab", "ty", "tx").distinct()
    up = tiles.select("slab", (F.col("ty") + 1).alias("ty"), "tx", F.lit(True).alias("up"))
    left = tiles.select("slab", "ty", (F.col("tx") + 1).alias("tx"), F.lit(True).alias("left"))
    trimmed = labels.join(up, ["slab", "ty", "tx"], "left").join(left, ["slab", "ty", "tx"], "left")
    trimmed = trimmed.where((F.col("up").isNull() | (F.col("yl") >= trim)) & (F.col("left").isNull() | (F.col("xl") >= trim)))
    return trimmed.groupBy("slab", "y", "x").agg(F.max_by("gid", F.struct("ty", "tx", "gid")).alias("gid"))


def band_votes(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``a, b, n``: how many voxels of the shared band have label a on one side and b on the other."""
    both = left.where("label > 0").withColumnRenamed("label", "a").join(right.where("label > 0").withColumnRenamed("label", "b"), on)
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


def mutual_links(votes: DataFrame, least: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs that are each other's best partner, within each band ``by``; ties go to the lowest partner."""
    best_b = votes.groupBy(*by, "a").agg(F.min_by("b", F.struct((-F.col("n")).alias("m"), "b")).alias("b"))
    best_a = votes.groupBy(*by, "b").agg(F.min_by("a", F.struct((-F.col("n")).alias("m"), "a")).alias("a"))
    return votes.where(F.col("n") >= least).join(best_b, [*by, "a", "b"], "left_semi").join(best_a, [*by, "a", "b"], "left_semi")


def directed_links(votes: DataFrame, least: int = 20, share: float = 0.7, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, a, b, n, side, cover``: one side's co-labelled band lies mostly in the other."""
    sides = None
    for side in ("a", "b"):
        cover = F.col("n") / F.sum("n").over(Window.partitionBy(*by, side))
        part = votes.withColumn("side", F.lit(side)).withColumn("cover", cover).where((F.col("n") >= least) & (F.col("cover") >= share))
        sides = part if sides is None else sides.union(part)
    return sides


def all_links(votes: DataFrame, least: int = 20, share: float = 0.7, by: tuple[str, ...] = ()) -> DataFrame:
    """Mutual and directed links, each pair of a band once."""
    return mutual_links(votes, least, by).select(*by, "a", "b").union(directed_links(votes, least, share, by).select(*by, "a", "b")).distinct()


def link_components(votes: DataFrame, links: DataFrame) -> DataFrame:
    """``side, label, root`` for all labels of the votes; sides are kept apart by sign (b as -b - 1)."""
    nodes = votes.select(F.lit("a").alias("side"), F.col("a").alias("label")).union(votes.select(F.lit("b"), "b")).distinct()
    code = F.when(F.col("side") == "a", F.col("label")).otherwise(-F.col("label") - 1)
    found = connected_components(links.select(F.col("a").alias("src"), (-F.col("b") - 1).alias("dst")))
    return nodes.withColumn("node", code).join(found, "node", "left").select("side", "label", F.coalesce("component", "node").alias("root"))


def agreement(votes: DataFrame, components: DataFrame) -> DataFrame:
    """One row: ``n_voxels, n_agree, rate``: band voxels whose two labels ended in one component."""
    a = components.where("side = 'a'").select(F.col("label").alias("a"), F.col("root").alias("root_a"))
    b = components.where("side = 'b'").select(F.col("label").alias("b"), F.col("root").alias("root_b"))
    both = votes.join(a, "a").join(b, "b")
    same = F.sum(F.when(F.col("root_a") == F.col("root_b"), F.col("n")).otherwise(0))
    return both.agg(F.sum("n").alias("n_voxels"), same.alias("n_agree"), (same / F.sum("n")).alias("rate"))


def disagreement_classes(votes: DataFrame, components: DataFrame, least: int = 20) -> DataFrame:
    """``class, n_pairs, n_voxels`` of votes that ended apart: weak, best partner of neither or of one side."""
    a = components.where("side = 'a'").select(F.col("label").alias("a"), F.col("root").alias("root_a"))
    b = components.where("side = 'b'").select(F.col("label").alias("b"), F.col("root").alias("root_b"))
    rank_a = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    rank_b = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))
    ranked = votes.withColumn("ra", rank_a).withColumn("rb", rank_b)
    apart = ranked.join(a, "a").join(b, "b").where("root_a != root_b")
    kind = F.when(F.col("n") < least, "weak").when((F.col("ra") == 1) | (F.col("rb") == 1), "non_mutual").otherwise("frag_split")
    return apart.groupBy(kind.alias("class")).agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n_voxels"))


def contiguous_slabs(slabs: DataFrame, depth: int, overlap: int) -> DataFrame:
    """``za, zb, linked``: consecutive slabs and whether the second starts where the first one's band does."""
    pairs = slabs.select(F.col("z0").alias("za")).withColumn("zb", F.lead("za").over(Window.orderBy("za"))).where("zb IS NOT NULL")
    return pairs.withColumn("linked", F.col("za") + depth - overlap == F.col("zb"))


def tile_ids(labels: DataFrame, whole: DataFrame, slab: DataFrame) -> DataFrame:
    """``tile, local, gid`` for ``labels`` (``tile, local``): from the table of the ``whole`` where that has the tile at all, else from the
    ``slab``'s; 0 where the table in charge does not have the label."""
    known = whole.select("tile").distinct().withColumn("known", F.lit(True))
    found = labels.join(known, "tile", "left").join(whole.withColumnRenamed("gid", "g"), ["tile", "local"], "left").join(slab.withColumnRenamed("gid", "s"), ["tile", "local"], "left")
    return found.select("tile", "local", F.coalesce(F.when(F.col("known"), F.col("g")).otherwise(F.col("s")), F.lit(0)).alias("gid"))


def slab_policies(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """``policy, slabs, missing, outcome``: how many of the ``wanted`` slabs (``slab``) each policy goes on with. ``fail`` and ``stop`` go on
    with none where one is missing, ``warn`` with those that are there."""
    seen = wanted.distinct().join(have.select("slab").distinct().withColumn("there", F.lit(True)), "slab", "left")
    count = seen.agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("missing"))
    policy = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(o).alias("word")) for p, o in (("fail", "failed"), ("stop", "stopped"), ("warn", "warned"))]))
    out = count.select("n", "missing", policy.alias("p")).select("p.*", "n", "missing")
    slabs = F.when(F.col("missing") == 0, F.col("n")).when(F.col("policy") == "warn", F.col("n") - F.col("missing")).otherwise(0)
    return out.select("policy", slabs.alias("slabs"), "missing", F.when(F.col("missing") == 0, "ok").otherwise(F.col("word")).alias("outcome"))


def dense_ids(df: DataFrame, root: str) -> DataFrame:
    """``root, id``: dense ids from 1 in the order of the roots. Ranks are taken over the table of roots only,
    within ranges of it: range partitions are counted first and offset, so no task sees them all."""
    roots = df.select(root).distinct().repartitionByRange(root).withColumn("__p", F.spark_partition_id())
    from laminar.storage import stage

    roots = stage(roots, "roots")
    counts = roots.groupBy("__p").agg(F.count("*").alias("c"))
    offset = counts.select("__p", (F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__o"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(root))
    return roots.withColumn("__r", rank).join(F.broadcast(offset), "__p").select(root, (F.col("__r") + F.col("__o")).cast("long").alias("id"))
