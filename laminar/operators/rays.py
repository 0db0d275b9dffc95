"""Ray casting over label canvases: crossings, pitch, layer counts and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminar.functions.columns import truncated
from laminar.functions.islands import islands, prev


def ray_samples(spark: SparkSession, rays: int, r_max: int, cy: float, cx: float, ny: int, nx: int) -> DataFrame:
    """``theta, r, y, x``: grid cells under each ray, from the centre out; cells off the grid are left out."""
    theta = F.col("theta") * F.lit(360.0 / rays)
    grid = spark.range(rays).select(F.col("id").alias("theta")).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r_max - 1).cast("long"))))
    y = truncated(F.lit(float(cy)) + F.col("r") * F.sin(F.radians(theta)))
    x = truncated(F.lit(float(cx)) + F.col("r") * F.cos(F.radians(theta)))
    placed = grid.select("theta", "r", y.alias("y"), x.alias("x"))
    return placed.where(F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1))


def ray_hits(canvas: DataFrame, samples: DataFrame) -> DataFrame:
    """``slab, theta, r, gid``: labelled samples. The samples are of fixed size (rays x radius) and broadcast."""
    return canvas.join(F.broadcast(samples), ["y", "x"]).select("slab", "theta", "r", "gid")


def crossings(hits: DataFrame, max_step: int = 1) -> DataFrame:
    """``slab, theta, k, r_vox, n_ids``: runs of labelled samples, a new one where the step exceeds ``max_step``."""
    keys = ["slab", "theta"]
    runs = islands(hits, keys, "r", F.col("r") - prev("r", keys, "r") > max_step, "k")
    return runs.groupBy(*keys, "k").agg(((F.min("r") + F.max("r")) / 2).alias("r_vox"), F.countDistinct("gid").alias("n_ids"))


def id_runs(hits: DataFrame) -> DataFrame:
    """``slab, theta, run, gid, first_r, last_r``: runs of one id after background is dropped."""
    keys = ["slab", "theta"]
    runs = islands(hits, keys, "r", F.col("gid") != prev("gid", keys, "r"), "run")
    return runs.groupBy(*keys, "run").agg(F.min("gid").alias("gid"), F.min("r").alias("first_r"), F.max("r").alias("last_r"))


def ray_cells(hits: DataFrame, um: float = 17.28, least: int = 3) -> DataFrame:
    """``slab, theta, n_distinct, n_runs, pitch_um, span_um, ratio`` per ray; pitch needs ``least`` crossings."""
    crossing = crossings(hits)
    along = Window.partitionBy("slab", "theta").orderBy("k")
    gap = crossing.withColumn("gap", F.col("r_vox") - F.lag("r_vox").over(along))
    shape = gap.groupBy("slab", "theta").agg(F.count("*").alias("n_runs"), F.median("gap").alias("gap"), (F.max("r_vox") - F.min("r_vox")).alias("span"))
    ids = hits.groupBy("slab", "theta").agg(F.countDistinct("gid").alias("n_distinct"))
    enough = F.col("n_runs") >= least
    return ids.join(shape, ["slab", "theta"]).select(
        "slab", "theta", "n_distinct", "n_runs", F.when(enough, F.col("gap") * um).alias("pitch_um"), F.when(enough, F.col("span") * um).alias("span_um"), F.when(enough, F.col("n_distinct") / (F.col("span") / F.col("gap") + 1)).alias("ratio")
    )


def pitch_summary(cells: DataFrame, least: int = 5) -> DataFrame:
    """Median, quartiles and outliers of pitch and ratio over cells with ``least`` ids and a pitch."""
    good = cells.where((F.col("n_distinct") >= least) & F.col("pitch_um").isNotNull())
    middle = good.agg(F.median("pitch_um").alias("m"))
    q = F.percentile("pitch_um", F.array(F.lit(0.25), F.lit(0.75)))
    summary = good.crossJoin(F.broadcast(middle)).agg(  # one row
        F.count("*").alias("n_cells"), F.median("pitch_um").alias("pitch_median"), q.alias("q"), F.median("ratio").alias("ratio_median"), F.count_if(F.col("pitch_um") > 2 * F.col("m")).alias("n_wide")
    )
    return summary.select("n_cells", "pitch_median", F.col("q")[0].alias("pitch_p25"), F.col("q")[1].alias("pitch_p75"), "ratio_median", "n_wide")


def layer_counts(hits: DataFrame) -> DataFrame:
    """``slab, n_rays, median_n, p10, p90, spread``: distinct ids per ray, summed up per slab."""
    per_ray = hits.groupBy("slab", "theta").agg(F.countDistinct("gid").alias("n"))
    p = F.percentile("n", F.array(F.lit(0.1), F.lit(0.9)))
    out = per_ray.groupBy("slab").agg(F.count("*").alias("n_rays"), F.median("n").alias("median_n"), p.alias("p"))
    spread = (F.col("p")[1] - F.col("p")[0]) / F.col("median_n")
    return out.select("slab", "n_rays", "median_n", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p90"), spread.alias("spread"))


def anchor_slab(counts: DataFrame, least: float) -> DataFrame:
    """The slab of least relative spread among those with enough layers."""
    best = counts.where(F.col("median_n") >= least).agg(F.min_by("slab", F.struct("spread", "slab")).alias("slab"), F.min("spread").alias("spread"))
    return best


def boundary_profile(per_slice: DataFrame, width: int = 9, near: int = 2) -> DataFrame:
    """``z, n, baseline, deviation, near_boundary`` for slices ``z, n, pos``: moving sum over ``width`` divided by it."""
    half = width // 2
    frame = Window.partitionBy("series").orderBy("z").rowsBetween(-half, half)
    base = F.sum("n").over(frame) / float(width)
    return per_slice.select("series", "z", "n", base.alias("baseline"), F.abs(F.col("n") - base).alias("deviation"), (F.col("pos") < near).alias("near_boundary"))


def boundary_means(profile: DataFrame) -> DataFrame:
    """``series, n_near, n_interior, near, interior, ratio`` of a ``boundary_profile``: mean deviation near slab boundaries and elsewhere."""
    near = F.col("near_boundary")
    out = profile.groupBy("series").agg(
        F.count_if(near).alias("n_near"), F.count_if(~near).alias("n_interior"), F.avg(F.when(near, F.col("deviation"))).alias("near"), F.avg(F.when(~near, F.col("deviation"))).alias("interior")
    )
    return out.withColumn("ratio", F.col("near") / F.col("interior"))
