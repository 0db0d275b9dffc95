"""Queries of the assembly: a tiled canvas in overlapping slabs, stitched within and across slabs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from laminar.component_table import ComponentTable, slab_part
from laminar.operators import assembly
from laminar.plans import adapters as A
from laminar.plans.registry import register, table
from laminar.storage import shared_dir, stage

TILE, STRIDE, TILES, DEPTH, OVERLAP, LEAST = 24, 18, 4, 16, 4, 8
STEP = DEPTH - OVERLAP
PARTS = 32  # folders of the component table, whatever the number of slabs


def labels(spark, sf_dir):
    """``slab, ty, tx, z, y, x, label``: rings of planes (a plane for each 125 order keys), cut into fragments that differ from tile
    to tile and slab to slab, under all tiles and slabs that cover a voxel."""
    li = table(spark, sf_dir, "lineitem")
    z, y = F.floor(F.col("l_orderkey") / 125).cast("long"), (F.col("l_partkey") % 65).cast("long")
    x = ((F.col("l_suppkey") * 13 + F.col("l_linenumber") * 29 + F.col("l_orderkey")) % 65).cast("long")
    r = F.sqrt((F.col("y") - 32) * (F.col("y") - 32) + (F.col("x") - 32) * (F.col("x") - 32))
    # dealt by planes once: the counts of bands by voxel need no further shuffle
    vox = li.select(z.alias("z"), y.alias("y"), x.alias("x")).repartition("z").distinct().withColumn("rad", r).where(F.col("rad") - 5 * F.floor(F.col("rad") / 5) < 3)
    k = F.floor(F.col("z") / STEP).cast("long")
    slabs = F.array_compact(F.array(k * STEP, F.when((F.col("z") % STEP < OVERLAP) & (k > 0), (k - 1) * STEP)))
    vox = vox.withColumn("slab", F.explode(slabs))
    from laminar.operators.stitch import covering_tiles

    cut = F.floor((F.col("y") + 5 * ((F.col("ty") + F.col("tx")) % 2) + 3 * (F.floor(F.col("slab") / STEP) % 2)) / 13)
    label = (F.floor(F.col("rad") / 5) * 8 + cut + 1).cast("long")
    return covering_tiles(vox, TILE, STRIDE, TILES).select("slab", "ty", "tx", "z", "y", "x", label.alias("label"))


LABELS_SQL = f"""
vox AS (SELECT z, y, x, sqrt(CAST((y - 32) * (y - 32) + (x - 32) * (x - 32) AS DOUBLE)) AS rad FROM (
  SELECT DISTINCT CAST(l_orderkey // 125 AS BIGINT) AS z, CAST(l_partkey % 65 AS BIGINT) AS y, CAST((l_suppkey * 13 + l_linenumber * 29 + l_orderkey) % 65 AS BIGINT) AS x FROM lineitem)),
ring AS (SELECT * FROM vox WHERE rad - 5 * floor(rad / 5) < 3),
slabbed AS (SELECT *, z // {STEP} AS k FROM ring UNION ALL SELECT *, z // {STEP} - 1 FROM ring WHERE z % {STEP} < {OVERLAP} AND z >= {STEP}),
grid AS (SELECT unnest(range(0, {TILES})) AS t),
lab AS (SELECT k * {STEP} AS slab, gy.t AS ty, gx.t AS tx, z, y, x, CAST(floor(rad / 5) AS BIGINT) * 8 + (y + 5 * ((gy.t + gx.t) % 2) + 3 * (k % 2)) // 13 + 1 AS label FROM slabbed, grid gy, grid gx
  WHERE y >= gy.t * {STRIDE} AND y < gy.t * {STRIDE} + {TILE} AND x >= gx.t * {STRIDE} AND x < gx.t * {STRIDE} + {TILE}),
tv AS (SELECT q.slab, q.ty, q.tx, 'left' AS band, p.label AS a, q.label AS b, count(*) AS n FROM lab p JOIN lab q ON q.slab = p.slab AND q.ty = p.ty AND q.tx = p.tx + 1 AND q.z = p.z AND q.y = p.y AND q.x = p.x GROUP BY 1, 2, 3, 5, 6
  UNION ALL SELECT q.slab, q.ty, q.tx, 'top', p.label, q.label, count(*) FROM lab p JOIN lab q ON q.slab = p.slab AND q.ty = p.ty + 1 AND q.tx = p.tx AND q.z = p.z AND q.y = p.y AND q.x = p.x GROUP BY 1, 2, 3, 5, 6)
"""


def _links_sql(votes: str, by: str) -> str:
    return f"""SELECT DISTINCT {by}, a, b FROM (SELECT *, row_number() OVER (PARTITION BY {by}, a ORDER BY n DESC, b) AS ra, row_number() OVER (PARTITION BY {by}, b ORDER BY n DESC, a) AS rb,
  CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY {by}, a) AS ca, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY {by}, b) AS cb FROM {votes}) WHERE n >= {LEAST} AND ((ra = 1 AND rb = 1) OR ca >= 0.7 OR cb >= 0.7)"""


INSTANCES_SQL = f"""{LABELS_SQL},
tl AS ({_links_sql('tv', 'slab, ty, tx, band')}),
node AS (SELECT slab, ty, tx, label, slab * 1000000000 + ty * 10000000 + tx * 100000 + label AS n FROM (SELECT DISTINCT slab, ty, tx, label FROM lab)),
te AS (SELECT slab * 1000000000 + CASE WHEN band = 'left' THEN ty * 10000000 + (tx - 1) * 100000 ELSE (ty - 1) * 10000000 + tx * 100000 END + a AS s, slab * 1000000000 + ty * 10000000 + tx * 100000 + b AS d FROM tl),
tsym AS (SELECT s, d FROM te UNION SELECT d, s FROM te),
treach AS (SELECT n AS s, n AS d FROM node UNION SELECT treach.s, tsym.d FROM treach JOIN tsym ON treach.d = tsym.s),
troot AS (SELECT s AS n, min(d) AS root FROM treach GROUP BY s),
inst AS (SELECT slab, ty, tx, label, dense_rank() OVER (PARTITION BY slab ORDER BY root) AS gid FROM node JOIN troot USING (n))"""

BANDS_SQL = f"""{INSTANCES_SQL},
li AS (SELECT lab.*, gid FROM lab JOIN inst USING (slab, ty, tx, label)),
sv AS (SELECT q.slab AS zb, q.ty, q.tx, p.gid AS a, q.gid AS b, count(*) AS n FROM li p JOIN li q ON q.slab = p.slab + {STEP} AND q.ty = p.ty AND q.tx = p.tx AND q.z = p.z AND q.y = p.y AND q.x = p.x GROUP BY 1, 2, 3, 4, 5)"""

WHOLE_SQL = f"""{BANDS_SQL},
sl AS (SELECT DISTINCT zb, a, b FROM ({_links_sql('sv', 'zb, ty, tx')})),
gn AS (SELECT DISTINCT slab * 1000000 + gid AS n FROM inst),
ge AS (SELECT (zb - {STEP}) * 1000000 + a AS s, zb * 1000000 + b AS d FROM sl),
gsym AS (SELECT s, d FROM ge UNION SELECT d, s FROM ge),
greach AS (SELECT n AS s, n AS d FROM gn UNION SELECT greach.s, gsym.d FROM greach JOIN gsym ON greach.d = gsym.s),
groot AS (SELECT s AS n, min(d) AS root FROM greach GROUP BY s)"""


@register("tile_band_votes", f"WITH {LABELS_SQL} SELECT slab, ty, tx, band, a, b, n FROM tv")
def tile_band_votes(spark, sf_dir):
    return assembly.tile_band_votes(labels(spark, sf_dir), TILE, STRIDE)


def _instances(spark, sf_dir):
    lab = labels(spark, sf_dir)  # made anew for each count, which costs one shuffle of three numbers a line
    return lab, stage(assembly.slab_instances(lab, stage(assembly.tile_band_votes(lab, TILE, STRIDE), "tilevotes"), LEAST), "instances")


@register("slab_instances", f"WITH RECURSIVE {INSTANCES_SQL} SELECT slab, ty, tx, label, gid FROM inst")
def slab_instances(spark, sf_dir):
    return _instances(spark, sf_dir)[1]


@register("slab_band_votes", f"WITH RECURSIVE {BANDS_SQL} SELECT zb, ty, tx, a, b, n FROM sv")
def slab_band_votes(spark, sf_dir):
    return assembly.slab_band_votes(*_instances(spark, sf_dir), DEPTH, OVERLAP)


def _whole(spark, sf_dir):
    lab, inst = _instances(spark, sf_dir)
    votes = stage(assembly.slab_band_votes(lab, inst, DEPTH, OVERLAP), "slabvotes")
    links = stage(assembly.slab_links(votes, STEP, LEAST), "slablinks")
    return inst, votes, links


@register("slab_pair_links", f"""WITH RECURSIVE {WHOLE_SQL}, v AS (SELECT zb, (zb - {STEP}) * 1000000 + a AS na, zb * 1000000 + b AS nb, n FROM sv)
  SELECT v.zb - {STEP} AS za, v.zb AS zb, coalesce(max(k.links), 0) AS links, CAST(sum(v.n) AS BIGINT) AS n_voxels, CAST(sum(CASE WHEN x.root = y.root THEN v.n ELSE 0 END) AS BIGINT) AS n_agree,
    round(sum(CASE WHEN x.root = y.root THEN v.n ELSE 0 END) / CAST(sum(v.n) AS DOUBLE), 9) AS rate
  FROM v JOIN groot x ON x.n = na JOIN groot y ON y.n = nb LEFT JOIN (SELECT zb, count(*) AS links FROM sl GROUP BY zb) k ON k.zb = v.zb GROUP BY v.zb""")  # fmt: skip
def slab_pair_links(spark, sf_dir):
    """Links and agreement of each pair of slabs on the components of the whole, found in one batch."""
    from laminar.graph import connected_components

    inst, votes, links = _whole(spark, sf_dir)
    nodes = assembly.slab_nodes(inst)
    comps = nodes.join(connected_components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return assembly.band_agreement(votes, links, comps, STEP).withColumn("rate", F.round("rate", 9))


@register("whole_instances", f"WITH RECURSIVE {WHOLE_SQL} SELECT slab, ty, tx, label, dense_rank() OVER (ORDER BY root) AS id FROM inst JOIN groot ON n = slab * 1000000 + gid")
def whole_instances(spark, sf_dir):
    """Ids of the whole volume by a stored component table that takes the first half of the slabs, then the rest as a delta."""
    inst, _, links = _whole(spark, sf_dir)
    middle = inst.agg(F.max("slab")).first()[0] // 2
    wide = middle * 2 // PARTS + 1
    comps = ComponentTable(spark, f"{shared_dir(spark)}/laminar-components-{uuid.uuid4().hex}", lambda node: F.floor(slab_part(assembly.GID_BITS)(node) / wide))
    for early in (True, False):
        some = inst.where((F.col("slab") <= middle) == early)
        comps.add(assembly.slab_nodes(some), links.where((F.col("zb") <= middle) == early))
    return assembly.whole_ids(inst, comps.read())
