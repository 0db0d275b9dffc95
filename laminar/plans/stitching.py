"""Queries of the voxel and stitching planes: masks, labels, votes, links, components, canvases."""

from __future__ import annotations

from pyspark.sql import functions as F

from laminar.operators import kernels, stitch, voxels
from laminar.plans import adapters as A
from laminar.plans.registry import register, table


@register("band_votes", f"WITH {A.VOTES_SQL} SELECT a, b, n FROM votes")
def band_votes(spark, sf_dir):
    return A.votes(spark, sf_dir)


@register("mutual_links", f"WITH {A.LINKS_SQL} SELECT a, b, n FROM mutual")
def mutual_links(spark, sf_dir):
    return stitch.mutual_links(A.votes(spark, sf_dir))


@register("directed_links", f"WITH {A.LINKS_SQL} SELECT a, b, n, side, round(cover, 9) AS cover FROM directed")
def directed_links(spark, sf_dir):
    return stitch.directed_links(A.votes(spark, sf_dir)).withColumn("cover", F.round("cover", 9))


@register("distinct_links", f"WITH {A.LINKS_SQL} SELECT a, b FROM links")
def distinct_links(spark, sf_dir):
    return stitch.all_links(A.votes(spark, sf_dir))


def _components(spark, sf_dir):
    votes = A.votes(spark, sf_dir)
    return votes, stitch.link_components(votes, stitch.all_links(votes))


@register("stitch_components", f"WITH RECURSIVE {A.COMPONENTS_SQL} SELECT CASE WHEN node >= 0 THEN 'a' ELSE 'b' END AS side, CASE WHEN node >= 0 THEN node ELSE -node - 1 END AS label, root FROM comp")
def stitch_components(spark, sf_dir):
    return _components(spark, sf_dir)[1]


@register(
    "stitch_agreement",
    f"""WITH RECURSIVE {A.COMPONENTS_SQL} SELECT CAST(sum(n) AS BIGINT) AS n_voxels, CAST(sum(CASE WHEN x.root = y.root THEN n ELSE 0 END) AS BIGINT) AS n_agree,
    round(sum(CASE WHEN x.root = y.root THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 9) AS rate FROM votes JOIN comp x ON x.node = a JOIN comp y ON y.node = -b - 1""",
)
def stitch_agreement(spark, sf_dir):
    return stitch.agreement(*_components(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


@register(
    "disagreement_classes",
    f"""WITH RECURSIVE {A.COMPONENTS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS rb FROM votes)
    SELECT CASE WHEN n < 20 THEN 'weak' WHEN ra = 1 OR rb = 1 THEN 'non_mutual' ELSE 'frag_split' END AS class, count(*) AS n_pairs, CAST(sum(n) AS BIGINT) AS n_voxels
    FROM ranked JOIN comp x ON x.node = a JOIN comp y ON y.node = -b - 1 WHERE x.root <> y.root GROUP BY 1""",
)
def disagreement_classes(spark, sf_dir):
    return stitch.disagreement_classes(*_components(spark, sf_dir))


@register("global_ids", f"WITH RECURSIVE {A.COMPONENTS_SQL} SELECT root, dense_rank() OVER (ORDER BY root) AS id FROM (SELECT DISTINCT root FROM comp)")
def global_ids(spark, sf_dir):
    return stitch.dense_ids(_components(spark, sf_dir)[1], "root")


@register(
    "slab_pair_agreement",
    """WITH v AS (SELECT l_orderkey // 2240 * 224 AS za, l_orderkey // 150 AS a, (l_orderkey + 40) // 150 AS b, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
    SELECT za, za + 224 AS zb, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS overlap, round(sum(CASE WHEN a = b THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 9) AS rate FROM v GROUP BY za""",
)
def slab_pair_agreement(spark, sf_dir):
    key = F.col("l_orderkey")
    v = table(spark, sf_dir, "lineitem").groupBy((F.floor(key / 2240) * 224).cast("long").alias("za"), F.floor(key / 150).alias("a"), F.floor((key + 40) / 150).alias("b")).agg(F.count("*").alias("n"))
    same = F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0))
    return v.groupBy("za", (F.col("za") + 224).alias("zb")).agg(F.count("*").alias("pairs"), F.sum("n").alias("overlap"), F.round(same / F.sum("n"), 9).alias("rate"))


@register(
    "contiguous_slabs",
    """WITH s AS (SELECT DISTINCT l_orderkey // 1000 * 224 + CASE WHEN l_orderkey // 1000 % 5 = 4 THEN 8 ELSE 0 END AS za FROM lineitem)
    SELECT za, zb, za + 224 = zb AS linked FROM (SELECT za, lead(za) OVER (ORDER BY za) AS zb FROM s) WHERE zb IS NOT NULL""",
)
def contiguous_slabs(spark, sf_dir):
    k = F.floor(F.col("l_orderkey") / 1000).cast("long")
    slabs = table(spark, sf_dir, "lineitem").select((k * 224 + F.when(k % 5 == 4, 8).otherwise(0)).alias("z0")).distinct()
    return stitch.contiguous_slabs(slabs, 256, 32)


_TILES_SQL = f"""{A.CANVAS_SQL}, t AS (SELECT unnest(range(0, 4)) AS t),
cov AS (SELECT slab, y, x, gid, ty.t AS ty, tx.t AS tx FROM canvas, t ty, t tx WHERE y >= ty.t * 18 AND y < ty.t * 18 + 24 AND x >= tx.t * 18 AND x < tx.t * 18 + 24)"""


def _tiles(spark, sf_dir):
    return stitch.covering_tiles(A.canvas(spark, sf_dir), 24, 18, 4)


@register(
    "covering_tiles",
    f"""WITH {_TILES_SQL} SELECT slab, y, x, gid, ty, tx, (ty = 0 OR y - ty * 18 >= 3) AND (tx = 0 OR x - tx * 18 >= 3) AS own FROM cov""",
)
def covering_tiles(spark, sf_dir):
    return _tiles(spark, sf_dir)


_COMPOSED = f"""{_TILES_SQL}, tl AS (SELECT *, gid * 10 + (ty + tx) % 2 AS g2 FROM cov), have AS (SELECT DISTINCT slab, ty, tx FROM tl),
kept AS (SELECT tl.* FROM tl LEFT JOIN have u ON u.slab = tl.slab AND u.ty = tl.ty - 1 AND u.tx = tl.tx LEFT JOIN have l ON l.slab = tl.slab AND l.ty = tl.ty AND l.tx = tl.tx - 1
  WHERE (u.slab IS NULL OR y - tl.ty * 18 >= 3) AND (l.slab IS NULL OR x - tl.tx * 18 >= 3))"""


@register("composed_canvas", f"WITH {_COMPOSED} SELECT slab, y, x, g2 AS gid FROM (SELECT *, row_number() OVER (PARTITION BY slab, y, x ORDER BY ty DESC, tx DESC) AS r FROM kept) WHERE r = 1")
def composed_canvas(spark, sf_dir):
    tiles = _tiles(spark, sf_dir).withColumns({"yl": F.col("y") - F.col("ty") * 18, "xl": F.col("x") - F.col("tx") * 18, "gid": F.col("gid") * 10 + (F.col("ty") + F.col("tx")) % 2})
    return stitch.compose_canvas(tiles, 3)


@register(
    "tile_occupancy",
    f"""WITH {_TILES_SQL}, o AS (SELECT slab, ty, tx, count(*) / 576.0 AS occupancy FROM cov GROUP BY slab, ty, tx) SELECT slab, ty, tx, round(occupancy, 9) AS occupancy FROM o WHERE occupancy >= 0.2""",
)
def tile_occupancy(spark, sf_dir):
    per = _tiles(spark, sf_dir).groupBy("slab", "ty", "tx").agg((F.count("*") / 576.0).alias("occupancy"))
    return per.where("occupancy >= 0.2").withColumn("occupancy", F.round("occupancy", 9))


@register(
    "tile_grid",
    """WITH n AS (SELECT l_orderkey // 7500 AS slab, 1000 + max(l_partkey) AS ny, 1000 + max(l_suppkey) * 3 AS nx FROM lineitem GROUP BY 1),
    g AS (SELECT slab, ny, nx, unnest(range(0, ny - 65 + 1, 448)) AS y0 FROM n), h AS (SELECT *, unnest(range(0, nx - 65 + 1, 448)) AS x0 FROM g)
    SELECT slab, y0, x0, least(512, ny - y0) AS ty, least(512, nx - x0) AS tx FROM h""",
)
def tile_grid(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 7500).cast("long").alias("slab")).agg((F.max("l_partkey") + 1000).alias("ny"), (F.max("l_suppkey") * 3 + 1000).alias("nx"))
    g = n.withColumn("y0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 65, F.lit(448).cast("long"))))
    g = g.repartition(4 * spark.sparkContext.defaultParallelism, "slab", "y0")  # few slabs stand for many tiles
    g = g.withColumn("x0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 65, F.lit(448).cast("long"))))
    return g.select("slab", "y0", "x0", F.least(F.lit(512), F.col("ny") - F.col("y0")).alias("ty"), F.least(F.lit(512), F.col("nx") - F.col("x0")).alias("tx"))


@register(
    "lut_fallback",
    """SELECT o_orderkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END, n_regionkey * 100, 0) AS gid
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_custkey % 40""",
)
def lut_fallback(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("g"), (F.col("c_custkey") % 40).alias("k"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_regionkey") * 100).alias("h"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(c, "c_custkey", "left").join(F.broadcast(n), "k", "left").select("o_orderkey", F.coalesce("g", "h", F.lit(0)).alias("gid"))  # nation: 25 rows


@register("gated_mask", f"WITH {A.VOXELS_SQL} SELECT slab, z, y, x, v, pred FROM voxels WHERE pred > 0 AND v > 0")
def gated_mask(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    ct = v.select("slab", "z", "y", "x", F.col("v").alias("ct"))
    return voxels.gate(v, ct).select("slab", "z", "y", "x", "v", "pred")


@register(
    "cleaning_report",
    f"""WITH {A.VOXELS_SQL}, raw AS (SELECT slab, count(*) FILTER (WHERE pred > 0) AS raw, count(*) FILTER (WHERE pred > 0 AND v > 0) AS gated FROM voxels GROUP BY slab)
    SELECT slab, raw, gated, round(100.0 * (raw - gated) / raw, 6) AS pct_removed FROM raw""",
)
def cleaning_report(spark, sf_dir):
    raw, both = F.col("pred") > 0, (F.col("pred") > 0) & (F.col("v") > 0)
    r = A.voxels(spark, sf_dir).groupBy("slab").agg(F.count_if(raw).alias("raw"), F.count_if(both).alias("gated"))
    return r.withColumn("pct_removed", F.round(100.0 * (F.col("raw") - F.col("gated")) / F.col("raw"), 6))


@register(
    "slice_statistics",
    f"""WITH {A.VOXELS_SQL}, d AS (SELECT slab, max(z) // 2 AS mid FROM voxels GROUP BY slab)
    SELECT slab, z, min(v) AS low, max(v) AS high, round(avg(v), 9) AS mean, round(100.0 * count(*) FILTER (WHERE pred > 0) / count(*), 6) AS coverage FROM voxels JOIN d USING (slab) WHERE z = mid GROUP BY slab, z""",
)
def slice_statistics(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    mid = v.groupBy("slab").agg(F.floor(F.max("z") / 2).cast("long").alias("z"))
    return v.join(mid, ["slab", "z"]).groupBy("slab", "z").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 9).alias("mean"), F.round(100.0 * F.count_if(F.col("pred") > 0) / F.count("*"), 6).alias("coverage"))


@register(
    "level_alignment",
    """WITH c AS (SELECT * FROM (VALUES ('a', 1, 2), ('b', 0, 3)) t(key, ct_offset, default_level)), p AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS key, o_custkey % 4 AS level, o_orderkey FROM orders)
    SELECT o_orderkey, key, level, level + ct_offset AS ct_level, level = default_level AS is_default FROM p JOIN c USING (key)""",
)
def level_alignment(spark, sf_dir):
    catalogue = spark.createDataFrame([("a", 1, 2), ("b", 0, 3)], "key string, ct_offset long, default_level long")
    p = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("key"), (F.col("o_custkey") % 4).alias("level"))
    both = p.join(F.broadcast(catalogue), "key")  # two rows
    return both.select("o_orderkey", "key", "level", (F.col("level") + F.col("ct_offset")).alias("ct_level"), (F.col("level") == F.col("default_level")).alias("is_default"))


@register("label_sizes", "SELECT l_partkey AS label, count(*) AS n FROM lineitem GROUP BY 1")
def label_sizes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("label")).agg(F.count("*").alias("n"))


@register("mega_filter", "WITH s AS (SELECT l_shipmode_ AS label, count(*) AS n FROM (SELECT CASE WHEN l_suppkey % 10 < 4 THEN 0 ELSE l_partkey END AS l_shipmode_ FROM lineitem) GROUP BY 1) SELECT label, n, n / CAST((SELECT sum(n) FROM s) AS DOUBLE) AS share FROM s WHERE n >= 0.03 * (SELECT sum(n) FROM s)")
def mega_filter(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_suppkey") % 10 < 4, 0).otherwise(F.col("l_partkey")).alias("label"))
    return voxels.mega_labels(li, "label", 0.03)


@register("size_filter", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 35)")
def size_filter(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return voxels.size_filter(li, ["l_partkey"], 35)


@register("depth_p90", "SELECT l_suppkey, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1")
def depth_p90(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.percentile("l_quantity", F.lit(0.9)).alias("p90"))


_BOUNDARY = f"""{A.LABELLED_SQL},
sh AS (SELECT p.slab, p.label AS p, q.label AS q, p.depth AS d1, q.depth AS d2 FROM labelled p JOIN labelled q ON p.slab = q.slab AND p.label <> q.label AND
  ((q.z = p.z + 1 AND q.y = p.y AND q.x = p.x) OR (q.z = p.z AND q.y = p.y + 1 AND q.x = p.x) OR (q.z = p.z AND q.y = p.y AND q.x = p.x + 1))),
bp AS (SELECT slab, least(p, q) AS a, greatest(p, q) AS b, count(*) AS n, avg(least(d1, d2)) AS mean_depth FROM sh GROUP BY 1, 2, 3),
st AS (SELECT slab, label, count(*) AS n, quantile_cont(depth, 0.9) AS p90 FROM labelled GROUP BY slab, label)"""


@register("boundary_pairs", f"WITH {_BOUNDARY} SELECT slab, a, b, n, round(mean_depth, 9) AS mean_depth FROM bp")
def boundary_pairs(spark, sf_dir):
    return voxels.boundary_pairs(A.labelled(spark, sf_dir)).withColumn("mean_depth", F.round("mean_depth", 9))


@register(
    "eligible_merges",
    f"""WITH {_BOUNDARY} SELECT bp.slab, a, b, bp.n, round(mean_depth, 9) AS mean_depth FROM bp JOIN st s ON s.slab = bp.slab AND s.label = a JOIN st t ON t.slab = bp.slab AND t.label = b
    WHERE bp.n BETWEEN 5 AND 60 AND mean_depth >= 0.5 * least(s.p90, t.p90)""",
)
def eligible_merges(spark, sf_dir):
    lab = A.labelled(spark, sf_dir)
    out = voxels.eligible_merges(voxels.boundary_pairs(lab), voxels.label_stats(lab), 5, 60, 0.5)
    return out.select("slab", "a", "b", "n", F.round("mean_depth", 9).alias("mean_depth"))


@register("capped_merge")
def capped_merge(spark, sf_dir):
    lab = A.labelled(spark, sf_dir)
    stats = voxels.label_stats(lab)
    return voxels.capped_merge(voxels.eligible_merges(voxels.boundary_pairs(lab), stats, 5, 60, 0.5), stats)


_MASK = f"""{A.VOXELS_SQL}, m AS (SELECT slab, z, y, x FROM voxels)"""


@register(
    "interior_voxels",
    f"""WITH {_MASK}, lim AS (SELECT 6 AS zz, 31 AS yy, 31 AS xx), near AS (SELECT a.slab, a.z, a.y, a.x, count(*) AS c FROM m a JOIN m b ON a.slab = b.slab AND b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3, 4)
    SELECT slab, z, y, x FROM near, lim WHERE c = (CASE WHEN z = 0 OR z = zz THEN 2 ELSE 3 END) * (CASE WHEN y = 0 OR y = yy THEN 2 ELSE 3 END) * (CASE WHEN x = 0 OR x = xx THEN 2 ELSE 3 END)""",
)
def interior_voxels(spark, sf_dir):
    return voxels.interior(A.voxels(spark, sf_dir), 32, 32, 7)


@register("voxel_component_sizes")
def voxel_component_sizes(spark, sf_dir):
    """Sizes of the 6-connected components of the whole mask; recursive SQL is too slow on it (brute force in the tests)."""
    sizes = voxels.voxel_components(A.voxels(spark, sf_dir).where("v > 0"), 32, 32).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.groupBy("n").agg(F.count("*").alias("components"))


@register(
    "thickness_proxy",
    """WITH s AS (SELECT l_suppkey AS label, count(*) AS n, count(DISTINCT l_partkey % 50) AS length FROM lineitem GROUP BY 1) SELECT label, n, length, n / CAST(length AS DOUBLE) AS proxy FROM s ORDER BY n DESC, label LIMIT 5""",
)
def thickness_proxy(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    sizes = li.groupBy(F.col("l_suppkey").alias("label")).agg(F.count("*").alias("n"))
    lines = li.groupBy(F.col("l_suppkey").alias("label")).agg(F.countDistinct(F.col("l_partkey") % 50).alias("length"))
    return voxels.thickness(sizes, lines)


@register(
    "largest_share",
    """WITH s AS (SELECT l_orderkey // 7500 AS slab, l_partkey AS label, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT slab, max(n) AS largest, CAST(sum(n) AS BIGINT) AS total, round(100.0 * max(n) / sum(n), 9) AS pct, count(*) AS instances FROM s GROUP BY slab""",
)
def largest_share(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 7500).cast("long").alias("slab"), "l_partkey").agg(F.count("*").alias("n"))
    return s.groupBy("slab").agg(F.max("n").alias("largest"), F.sum("n").alias("total"), F.round(100.0 * F.max("n") / F.sum("n"), 9).alias("pct"), F.count("*").alias("instances"))


@register(
    "persistent_labels",
    """WITH c AS (SELECT l_partkey AS gid, l_linenumber AS zl, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT gid, min(n) AS low, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY gid HAVING count(DISTINCT zl) = 7 AND min(n) > 2""",
)
def persistent_labels(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gid"), F.col("l_linenumber").alias("zl")).agg(F.count("*").alias("n"))
    return c.groupBy("gid").agg(F.min("n").alias("low"), F.sum("n").alias("n"), F.countDistinct("zl").alias("z")).where("z = 7 AND low > 2").select("gid", "low", "n")


@register(
    "top_candidates",
    "WITH c AS (SELECT l_partkey AS gid, l_linenumber AS zl, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT gid, max(n) AS top FROM c GROUP BY gid) SELECT gid, top FROM m WHERE top > 3 ORDER BY top DESC, gid LIMIT 40",
)
def top_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gid"), "l_linenumber").agg(F.count("*").alias("n"))
    return c.groupBy("gid").agg(F.max("n").alias("top")).where("top > 3").orderBy(F.desc("top"), "gid").limit(40)


@register(
    "palette",
    "SELECT gid, k, round(CAST(k AS DOUBLE) * CAST(0.6180339887498949 AS DOUBLE) - floor(CAST(k AS DOUBLE) * CAST(0.6180339887498949 AS DOUBLE)), 9) AS hue FROM (SELECT l_partkey AS gid, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS k FROM lineitem GROUP BY l_partkey)",
)
def palette(spark, sf_dir):
    from laminar.functions.columns import hue

    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gid")).agg(F.count("*").alias("n"))
    k = stitch.dense_ids(c.withColumn("o", F.struct((-F.col("n")).alias("m"), "gid")), "o")
    return k.select("o.gid", F.col("id").alias("k"), F.round(hue(F.col("id")), 9).alias("hue"))


def _tile_voxels(spark, sf_dir):
    v = A.voxels(spark, sf_dir).where("v > 0")
    return v.select("slab", F.floor(F.col("y") / 16).cast("long").alias("ty"), F.floor(F.col("x") / 16).cast("long").alias("tx"), F.col("z").alias("zl"), (F.col("y") % 16).alias("yl"), (F.col("x") % 16).alias("xl"), (F.col("v") / 50.0).alias("v"))


@register(
    "distance_field",
    f"""WITH {A.VOXELS_SQL}, t AS (SELECT slab, y // 16 AS ty, x // 16 AS tx, z AS zl, y % 16 AS yl, x % 16 AS xl FROM voxels WHERE v > 0),
    g AS (SELECT DISTINCT slab, ty, tx FROM t), box AS (SELECT slab, ty, tx, a.i AS zl, b.i AS yl, c.i AS xl FROM g, range(7) a(i), range(16) b(i), range(16) c(i)),
    bg AS (SELECT * FROM box ANTI JOIN t USING (slab, ty, tx, zl, yl, xl))
    SELECT t.slab, t.ty, t.tx, t.zl, t.yl, t.xl, round(sqrt(CAST(min((t.zl - bg.zl) ** 2 + (t.yl - bg.yl) ** 2 + (t.xl - bg.xl) ** 2) AS DOUBLE)), 9) AS d
    FROM t JOIN bg USING (slab, ty, tx) GROUP BY 1, 2, 3, 4, 5, 6""",
)
def distance_field(spark, sf_dir):
    v = _tile_voxels(spark, sf_dir)
    out = kernels.per_tile(v, lambda b: {"d": kernels.distance(b > 0)}, (7, 16, 16), {"d": "double"}, "v")
    return out.where("d < double('infinity')").withColumn("d", F.round("d", 9))


@register("separated_instances")
def separated_instances(spark, sf_dir):
    return kernels.per_tile(_tile_voxels(spark, sf_dir), lambda b: {"label": kernels.separate(b > 0, 1.5)}, (7, 16, 16), {"label": "long"}, "v")


@register("sheet_ridges")
def sheet_ridges(spark, sf_dir):
    return kernels.per_tile(_tile_voxels(spark, sf_dir), lambda b: {"ridge": kernels.ridges(b)}, (7, 16, 16), {"ridge": "boolean"}, "v")


@register("equalised_slices")
def equalised_slices(spark, sf_dir):
    import numpy as np

    return kernels.per_tile(_tile_voxels(spark, sf_dir), lambda b: {"v": np.stack([kernels.equalise(p, 8) for p in b])}, (7, 16, 16), {"v": "double"}, "v")


@register("contact_dips")
def contact_dips(spark, sf_dir):
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        block = np.zeros((7, 16, 16))
        block[pdf["zl"], pdf["yl"], pdf["xl"]] = pdf["v"]
        return pd.DataFrame([{"slab": pdf["slab"].iloc[0], "ty": pdf["ty"].iloc[0], "tx": pdf["tx"].iloc[0], **kernels.dip(block, 4)}])

    return _tile_voxels(spark, sf_dir).groupBy("slab", "ty", "tx").applyInPandas(one, "slab long, ty long, tx long, shoulder double, dip double, dip_over_contrast double, contrast double")
