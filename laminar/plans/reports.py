"""Queries of windows over z, coverage, samples and the short reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminar.functions.columns import truncated
from laminar.plans import adapters as A
from laminar.plans.constraints import _SUPPORT, _gaps
from laminar.plans.registry import register, table
from laminar.plans.stitching import contact_dips


@register(
    "fractional_slices",
    f"""WITH {A.VOXELS_SQL}, n AS (SELECT slab, max(z) + 1 AS n FROM voxels GROUP BY slab), f AS (SELECT slab, n, unnest([0.0, 0.25, 0.5, 0.99, 1.0]::DOUBLE[]) AS frac FROM n)
    SELECT f.slab, frac, CAST(least(trunc(n * frac), n - 1) AS BIGINT) AS z, count(v.x) AS voxels FROM f LEFT JOIN voxels v ON v.slab = f.slab AND v.z = CAST(least(trunc(n * frac), n - 1) AS BIGINT) GROUP BY 1, 2, 3""",
)
def fractional_slices(spark, sf_dir):
    v = A.voxels(spark, sf_dir)
    n = v.groupBy("slab").agg((F.max("z") + 1).alias("n"))
    at = n.withColumn("frac", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.99, 1.0)]))).withColumn("z", F.least(truncated(F.col("n") * F.col("frac")), F.col("n") - 1))
    return at.join(v, ["slab", "z"], "left").groupBy("slab", "frac", "z").agg(F.count("x").alias("voxels"))


@register(
    "common_extent",
    """WITH a AS (SELECT l_orderkey // 7500 AS slab, l_linenumber AS z, max(l_partkey) AS ny, max(l_suppkey) AS nx FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
    b AS (SELECT l_orderkey // 7500 AS slab, l_linenumber AS z, max(l_partkey) AS ny, max(l_suppkey) AS nx FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
    SELECT slab, min(z) AS z0, max(z) AS z1, min(least(a.ny, b.ny)) AS ny, min(least(a.nx, b.nx)) AS nx FROM a JOIN b USING (slab, z) WHERE z BETWEEN 2 AND 6 GROUP BY slab""",
)
def common_extent(spark, sf_dir):
    def size(flag):
        li = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == flag) & F.col("l_linenumber").between(2, 6))
        return li.groupBy(F.floor(F.col("l_orderkey") / 7500).cast("long").alias("slab"), F.col("l_linenumber").alias("z")).agg(F.max("l_partkey").alias(f"y{flag}"), F.max("l_suppkey").alias(f"x{flag}"))

    both = size("A").join(size("N"), ["slab", "z"])
    return both.groupBy("slab").agg(F.min("z").alias("z0"), F.max("z").alias("z1"), F.min(F.least("yA", "yN")).alias("ny"), F.min(F.least("xA", "xN")).alias("nx"))


@register("interior_slabs", f"WITH {A.CELLS_SQL} SELECT slab, count(*) AS n_cells, count(pitch_um) AS with_pitch FROM raycells WHERE slab + 112 > 224 AND slab + 112 < 1400 GROUP BY slab")
def interior_slabs(spark, sf_dir):
    from laminar.operators.rays import ray_cells

    mid = F.col("slab") + 112
    return ray_cells(A.hits(spark, sf_dir)).where((mid > 224) & (mid < 1400)).groupBy("slab").agg(F.count("*").alias("n_cells"), F.count("pitch_um").alias("with_pitch"))


@register("z_window", "SELECT l_orderkey, l_linenumber, l_partkey AS z FROM lineitem WHERE abs(l_partkey - (SELECT CAST(max(l_partkey) // 2 AS BIGINT) FROM lineitem)) <= 16")
def z_window(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("z"))
    mid = li.agg(F.floor(F.max("z") / 2).cast("long").alias("mid"))
    return li.crossJoin(F.broadcast(mid)).where(F.abs(F.col("z") - F.col("mid")) <= 16).drop("mid")  # one row


@register("seedless_voxels", f"WITH {A.LABELLED_SQL}, seeds AS (SELECT DISTINCT slab, label FROM labelled WHERE depth >= 48 AND label % 7 <> 3) SELECT slab, z, y, x, label FROM labelled l WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.slab = l.slab AND s.label = l.label)")
def seedless_voxels(spark, sf_dir):
    lab = A.labelled(spark, sf_dir)
    seeds = lab.where("depth >= 48 AND label % 7 != 3").select("slab", "label").distinct()
    return lab.join(seeds, ["slab", "label"], "left_anti").select("slab", "z", "y", "x", "label")


@register("pair_coverage", f"WITH {_SUPPORT} SELECT slab, theta // 10 AS sector, count(*) AS n, count(DISTINCT least(a, b) * 1000 + greatest(a, b)) AS pairs FROM gw GROUP BY 1, 2")
def pair_coverage(spark, sf_dir):
    sector = F.floor(F.col("theta") / 10).cast("long")
    return _gaps(spark, sf_dir).groupBy("slab", sector.alias("sector")).agg(F.count("*").alias("n"), F.countDistinct(F.least("a", "b"), F.greatest("a", "b")).alias("pairs"))


@register(
    "histogram_percentiles",
    """WITH h AS (SELECT l_suppkey AS gid, CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (PARTITION BY gid ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY gid) AS total FROM h)
    SELECT gid, min(bin) FILTER (WHERE upto >= 0.05 * total) AS p5, min(bin) FILTER (WHERE upto >= 0.95 * total) AS p95 FROM c GROUP BY gid""",
)
def histogram_percentiles(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("gid"), F.floor(F.col("l_quantity") / 5).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    along = Window.partitionBy("gid").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = h.withColumns({"upto": F.sum("n").over(along), "total": F.sum("n").over(Window.partitionBy("gid"))})
    return c.groupBy("gid").agg(F.min(F.when(F.col("upto") >= 0.05 * F.col("total"), F.col("bin"))).alias("p5"), F.min(F.when(F.col("upto") >= 0.95 * F.col("total"), F.col("bin"))).alias("p95"))


@register("hash_sample", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY (l_orderkey * 7919 + l_linenumber * 104729) % 1000003, l_orderkey, l_linenumber LIMIT 200")
def hash_sample(spark, sf_dir):
    """A sampling operator: the 200 rows of smallest mixed key."""
    mixed = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1000003
    return table(spark, sf_dir, "lineitem").orderBy(mixed, "l_orderkey", "l_linenumber").limit(200).select("l_orderkey", "l_linenumber")


@register(
    "shared_tiles",
    """WITH t AS (SELECT DISTINCT l_orderkey // 7500 AS slab, l_partkey % 300 AS tile FROM lineitem WHERE (l_partkey + l_suppkey) % 3 = 0) SELECT a.slab AS za, b.slab AS zb, count(*) AS tiles FROM t a JOIN t b ON b.slab = a.slab + 1 AND b.tile = a.tile GROUP BY 1, 2""",
)
def shared_tiles(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").where("(l_partkey + l_suppkey) % 3 = 0").select(F.floor(F.col("l_orderkey") / 7500).cast("long").alias("za"), (F.col("l_partkey") % 300).alias("tile")).distinct()
    after = t.select((F.col("za") - 1).alias("za"), "tile", F.col("za").alias("zb"))
    return t.join(after, ["za", "tile"]).groupBy("za", "zb").agg(F.count("*").alias("tiles"))


@register(
    "missing_slabs",
    """WITH h AS (SELECT DISTINCT l_orderkey // 500 AS slab FROM lineitem WHERE l_suppkey % 4 = 0 AND l_orderkey // 500 % 9 <> 4), w AS (SELECT unnest(range(CAST((SELECT max(slab) FROM h) AS BIGINT) + 1)) AS slab)
    SELECT slab, h.slab IS NULL AS missing FROM w LEFT JOIN h USING (slab)""",
)
def missing_slabs(spark, sf_dir):
    slab = F.floor(F.col("l_orderkey") / 500).cast("long")
    h = table(spark, sf_dir, "lineitem").where((F.col("l_suppkey") % 4 == 0) & (slab % 9 != 4)).select(slab.alias("slab")).distinct()
    w = h.agg(F.max("slab").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("slab"))
    return w.join(h.withColumn("there", F.lit(True)), "slab", "left").select("slab", F.col("there").isNull().alias("missing"))


@register("voxel_space", "SELECT l_orderkey, l_linenumber, l_partkey * 2 AS full_y, l_partkey // 2 AS half_y, round(l_quantity * 17.28, 6) AS r_um, l_orderkey // 7500 * 224 + l_linenumber AS z_global FROM lineitem")
def voxel_space(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    z = F.floor(F.col("l_orderkey") / 7500).cast("long") * 224 + F.col("l_linenumber")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("full_y"), F.floor(F.col("l_partkey") / 2).cast("long").alias("half_y"), F.round(F.col("l_quantity") * 17.28, 6).alias("r_um"), z.alias("z_global"))


@register(
    "window_centres",
    """WITH n AS (SELECT DISTINCT 'slice-' || (o_custkey * 10) || '-' || (o_custkey * 10 + 800) AS name FROM orders), p AS (SELECT name, CAST(regexp_extract(name, 'slice-([0-9]+)-([0-9]+)', 1) AS BIGINT) AS a, CAST(regexp_extract(name, 'slice-([0-9]+)-([0-9]+)', 2) AS BIGINT) AS b FROM n)
    SELECT name, (a + b) // 2 + d AS z FROM p, (SELECT unnest([-200, 0, 200]) AS d)""",
)
def window_centres(spark, sf_dir):
    c = F.col("o_custkey") * 10
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("slice-"), c.cast("string"), F.lit("-"), (c + 800).cast("string")).alias("name")).distinct()
    part = lambda k: F.regexp_extract("name", r"slice-([0-9]+)-([0-9]+)", k).cast("long")
    mid = F.floor((part(1) + part(2)) / 2).cast("long")
    return names.select("name", F.explode(F.sequence(mid - 200, mid + 200, F.lit(200).cast("long"))).alias("z"))


@register(
    "seed_report",
    """WITH s AS (SELECT o_custkey, round(100.0 * avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END), 3) AS pct, count(*) AS n FROM orders GROUP BY 1)
    SELECT n, count(*) AS seeds, count(*) FILTER (WHERE pct >= 60) AS high, max(pct) AS best, string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY pct DESC, o_custkey) AS listed FROM s GROUP BY n""",
)
def seed_report(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(100.0 * F.avg(F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0)), 3).alias("pct"), F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("pct")).alias("m"), "o_custkey"))), lambda e: e["o_custkey"].cast("string")), ",")
    return s.groupBy("n").agg(F.count("*").alias("seeds"), F.count_if(F.col("pct") >= 60).alias("high"), F.max("pct").alias("best"), listed.alias("listed"))


@register("dip_report")
def dip_report(spark, sf_dir):
    d = contact_dips(spark, sf_dir)
    return d.groupBy("slab").agg(F.count("*").alias("sites"), F.median("dip").alias("dip"), F.median("dip_over_contrast").alias("relative"), F.avg((F.col("dip_over_contrast") >= 0.25).cast("int")).alias("share"))


@register("tile_stats", f"WITH {A.LABELLED_SQL} SELECT slab, y // 16 AS ty, x // 16 AS tx, count(*) AS mask_voxels, count(DISTINCT label) AS instances, round(avg(depth), 9) AS mean_depth FROM labelled GROUP BY 1, 2, 3")
def tile_stats(spark, sf_dir):
    lab = A.labelled(spark, sf_dir)
    t = [F.floor(F.col(c) / 16).cast("long").alias(f"t{c}") for c in ("y", "x")]
    return lab.groupBy("slab", *t).agg(F.count("*").alias("mask_voxels"), F.countDistinct("label").alias("instances"), F.round(F.avg("depth"), 9).alias("mean_depth"))


@register(
    "terminus_steps",
    f"""WITH {A.CROSSINGS_SQL}, last AS (SELECT slab, theta, max(r_vox) AS r FROM crossings GROUP BY 1, 2), s AS (SELECT *, lag(r) OVER (PARTITION BY slab ORDER BY theta) AS before FROM last)
    SELECT slab, slab + 12 AS z_abs, theta * 6.0::DOUBLE AS theta_deg, before AS r_before, r AS r_after, before - r AS step_vox FROM s WHERE before - r > 2""",
)
def terminus_steps(spark, sf_dir):
    """Where the outermost layer ends: rays whose last crossing steps inwards."""
    from laminar.operators.rays import crossings

    last = crossings(A.hits(spark, sf_dir)).groupBy("slab", "theta").agg(F.max("r_vox").alias("r_after"))
    s = last.withColumn("r_before", F.lag("r_after").over(Window.partitionBy("slab").orderBy("theta")))
    return s.where("r_before - r_after > 2").select("slab", (F.col("slab") + 12).alias("z_abs"), (F.col("theta") * 6.0).alias("theta_deg"), "r_before", "r_after", (F.col("r_before") - F.col("r_after")).alias("step_vox"))
