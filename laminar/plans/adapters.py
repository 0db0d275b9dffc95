"""Views of the given tables in the engine's shapes, in Spark and as SQL for the oracle.

``canvas``: labelled cells of 65 x 65 planes, rings around the centre, a plane per slab. Slabs follow the
order keys, so the number of planes grows with the table. ``voxels``: a mask with a scanned value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.plans.given import table

SIDE = 65


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    y = F.col("l_partkey") % SIDE
    x = (F.col("l_suppkey") * 13 + F.col("l_linenumber") * 29 + F.col("l_orderkey")) % SIDE
    slab = F.floor(F.col("l_orderkey") / 7500).cast("long") * 224
    return li.select(slab.alias("slab"), y.cast("long").alias("y"), x.cast("long").alias("x")).distinct()


def canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.sqrt((F.col("y") - 32) * (F.col("y") - 32) + (F.col("x") - 32) * (F.col("x") - 32))
    ringed = cells(spark, sf_dir).withColumn("rad", r).where(F.col("rad") - 5 * F.floor(F.col("rad") / 5) < 3)
    return ringed.select("slab", "y", "x", (F.floor(F.col("rad") / 5) + 1).cast("long").alias("gid"))


CANVAS_SQL = """
cells AS (SELECT DISTINCT CAST(l_orderkey // 7500 * 224 AS BIGINT) AS slab, CAST(l_partkey % 65 AS BIGINT) AS y,
            CAST((l_suppkey * 13 + l_linenumber * 29 + l_orderkey) % 65 AS BIGINT) AS x FROM lineitem),
canvas AS (SELECT slab, y, x, CAST(floor(rad / 5) AS BIGINT) + 1 AS gid
           FROM (SELECT *, sqrt(CAST((y - 32) * (y - 32) + (x - 32) * (x - 32) AS DOUBLE)) AS rad FROM cells) WHERE rad - 5 * floor(rad / 5) < 3)
"""

HITS_SQL = (
    CANVAS_SQL
    + """,
samples AS (SELECT theta, r, y, x FROM (
    SELECT t.i AS theta, s.i AS r, CAST(trunc(32.0 + s.i * sin(radians(t.i * 6.0))) AS BIGINT) AS y, CAST(trunc(32.0 + s.i * cos(radians(t.i * 6.0))) AS BIGINT) AS x
    FROM range(60) t(i), range(46) s(i)) WHERE y BETWEEN 0 AND 64 AND x BETWEEN 0 AND 64),
hits AS (SELECT slab, theta, r, gid FROM canvas JOIN samples USING (y, x))
"""
)

CROSSINGS_SQL = (
    HITS_SQL
    + """,
marked AS (SELECT *, CASE WHEN r - lag(r) OVER (PARTITION BY slab, theta ORDER BY r) <= 1 THEN 0 ELSE 1 END AS s FROM hits),
runs AS (SELECT *, CAST(sum(s) OVER (PARTITION BY slab, theta ORDER BY r ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS k FROM marked),
crossings AS (SELECT slab, theta, k, (min(r) + max(r)) / 2.0 AS r_vox, count(DISTINCT gid) AS n_ids FROM runs GROUP BY slab, theta, k)
"""
)

CELLS_SQL = (
    CROSSINGS_SQL
    + """,
gaps AS (SELECT *, r_vox - lag(r_vox) OVER (PARTITION BY slab, theta ORDER BY k) AS gap FROM crossings),
shape AS (SELECT slab, theta, count(*) AS n_runs, median(gap) AS gap, max(r_vox) - min(r_vox) AS span FROM gaps GROUP BY slab, theta),
ids AS (SELECT slab, theta, count(DISTINCT gid) AS n_distinct FROM hits GROUP BY slab, theta),
raycells AS (SELECT slab, theta, n_distinct, n_runs, CASE WHEN n_runs >= 3 THEN gap * 17.28 END AS pitch_um, CASE WHEN n_runs >= 3 THEN span * 17.28 END AS span_um,
    CASE WHEN n_runs >= 3 THEN n_distinct / (span / gap + 1) END AS ratio FROM ids JOIN shape USING (slab, theta))
"""
)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from laminar.operators.rays import ray_hits, ray_samples

    return ray_hits(canvas(spark, sf_dir), ray_samples(spark, 60, 46, 32, 32, SIDE, SIDE))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One voxel set under two labellings: the band of two neighbouring tiles."""
    from laminar.operators.stitch import band_votes

    li = table(spark, sf_dir, "lineitem")
    key = [F.col("l_orderkey").alias("v"), F.col("l_linenumber").alias("w"), F.col("l_partkey").alias("p")]
    a = li.select(*key, (F.floor(F.col("l_orderkey") / 200) * 200 + 1).cast("long").alias("label"))
    width = F.when(F.col("l_orderkey") % 3000 >= 1500, 100).otherwise(200)
    b = li.select(*key, (F.floor((F.col("l_orderkey") + 60) / width) * width + 1).cast("long").alias("label"))
    return band_votes(a, b, ["v", "w", "p"])


VOTES_SQL = """
vox AS (SELECT l_orderkey AS v, l_linenumber AS w, l_partkey AS p, l_orderkey // 200 * 200 + 1 AS a,
          CASE WHEN l_orderkey % 3000 >= 1500 THEN (l_orderkey + 60) // 100 * 100 + 1 ELSE (l_orderkey + 60) // 200 * 200 + 1 END AS b FROM lineitem),
votes AS (SELECT x.a, y.b, count(*) AS n FROM vox x JOIN vox y USING (v, w, p) GROUP BY x.a, y.b)
"""

LINKS_SQL = (
    VOTES_SQL
    + """,
mutual AS (SELECT a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS rb FROM votes)
           WHERE ra = 1 AND rb = 1 AND n >= 20),
cover AS (SELECT a, b, n, 'a' AS side, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY a) AS cover FROM votes
          UNION ALL SELECT a, b, n, 'b', CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY b) FROM votes),
directed AS (SELECT * FROM cover WHERE n >= 20 AND cover >= 0.7),
links AS (SELECT a, b FROM mutual UNION SELECT a, b FROM directed)
"""
)

COMPONENTS_SQL = (
    LINKS_SQL
    + """,
nodes AS (SELECT a AS node FROM votes UNION SELECT -b - 1 FROM votes),
sym AS (SELECT a AS s, -b - 1 AS d FROM links UNION SELECT -b - 1, a FROM links),
reach AS (SELECT node AS s, node AS d FROM nodes UNION SELECT reach.s, sym.d FROM reach JOIN sym ON reach.d = sym.s),
comp AS (SELECT s AS node, min(d) AS root FROM reach GROUP BY s)
"""
)


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slab, z, y, x, v, pred``: scanned value and prediction of the voxels of 7 x 32 x 32 grids."""
    li = table(spark, sf_dir, "lineitem")
    at = li.select(
        F.floor(F.col("l_orderkey") / 7500).cast("long").alias("slab"), (F.col("l_linenumber") - 1).cast("long").alias("z"), (F.col("l_partkey") % 32).alias("y"), ((F.col("l_suppkey") * 7 + F.col("l_orderkey")) % 32).alias("x"), F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("f")
    )
    return at.groupBy("slab", "z", "y", "x").agg(F.max(F.when(F.col("q") > 10, F.col("q")).otherwise(0)).alias("v"), F.max(F.when(F.col("f") != "A", 1).otherwise(0)).cast("long").alias("pred"))


VOXELS_SQL = """
voxels AS (SELECT CAST(l_orderkey // 7500 AS BIGINT) AS slab, CAST(l_linenumber - 1 AS BIGINT) AS z, l_partkey % 32 AS y, (l_suppkey * 7 + l_orderkey) % 32 AS x,
    max(CASE WHEN CAST(l_quantity AS BIGINT) > 10 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS v, CAST(max(CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END) AS BIGINT) AS pred
  FROM lineitem GROUP BY 1, 2, 3, 4)
"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slab, z, y, x, label, depth``: mask voxels under a blocky labelling."""
    m = voxels(spark, sf_dir).where("pred > 0 AND v > 0")
    label = F.floor(F.col("y") / 5) * 10 + F.floor(F.col("x") / 7) + 1
    return m.select("slab", "z", "y", "x", label.cast("long").alias("label"), F.col("v").cast("double").alias("depth"))


LABELLED_SQL = (
    VOXELS_SQL
    + """,
labelled AS (SELECT slab, z, y, x, CAST(y // 5 * 10 + x // 7 + 1 AS BIGINT) AS label, CAST(v AS DOUBLE) AS depth FROM voxels WHERE pred > 0 AND v > 0)
"""
)
