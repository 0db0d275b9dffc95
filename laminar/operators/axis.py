"""The scroll axis: centroids per slice, smoothing, checks, nearest and interpolated lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminar.functions.columns import running_median


def centroids(mask: DataFrame, least: int = 1) -> DataFrame:
    """``z, cy, cx, n`` per slice with at least ``least`` voxels."""
    return mask.groupBy("z").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count("*").alias("n")).where(F.col("n") >= least)


def owned_centroids(mask: DataFrame, slices: DataFrame, cy: float, cx: float) -> DataFrame:
    """``slab, z, cy, cx, n`` for every slice of ``slices`` (``slab, z``): the centre of the voxels that their tile owns (``own``), so
    that overlaps count once; the given centre where a slice has none."""
    found = mask.where("own").groupBy("slab", "z").agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.count("*").alias("n"))
    both = slices.join(found, ["slab", "z"], "left")
    return both.select("slab", "z", F.coalesce("y", F.lit(cy)).alias("cy"), F.coalesce("x", F.lit(cx)).alias("cx"), F.coalesce("n", F.lit(0)).alias("n"))


def trimmed_centroids(mask: DataFrame, by: list[str], trim: float, least: int, cy: float, cx: float) -> DataFrame:
    """``by, cy, cx, n, n_kept``: per group the centre of the voxels between its ``trim`` and ``1 - trim`` quantiles on both axes
    (bounds included); the given centre where fewer than ``least`` are left. Two passes: quantiles, then means."""
    p = F.array(F.lit(trim), F.lit(1 - trim))
    bounds = mask.groupBy(*by).agg(F.percentile("y", p).alias("py"), F.percentile("x", p).alias("px"), F.count("*").alias("n"))
    inside = mask.join(bounds.select(*by, "py", "px"), by).where("y BETWEEN py[0] AND py[1] AND x BETWEEN px[0] AND px[1]")
    kept = inside.groupBy(*by).agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.count("*").alias("k"))
    both = bounds.select(*by, "n").join(kept, by, "left").withColumn("k", F.coalesce("k", F.lit(0)))
    enough = F.col("k") >= least
    return both.select(*by, F.when(enough, F.col("y")).otherwise(cy).alias("cy"), F.when(enough, F.col("x")).otherwise(cx).alias("cx"), "n", F.col("k").alias("n_kept"))


def first_slab_wins(points: DataFrame) -> DataFrame:
    """One row per global z: that of the first slab."""
    rank = F.row_number().over(Window.partitionBy("z").orderBy("slab"))
    return points.withColumn("__r", rank).where("__r = 1").drop("__r")


def smooth_axis(points: DataFrame, by: list[str], width: int = 5) -> DataFrame:
    """Running median of ``cy`` and ``cx`` along z, edges clipped, within each group ``by``."""
    half = width // 2
    frame = Window.partitionBy(*by).orderBy("z").rowsBetween(-half, half)
    return points.select(*by, "z", running_median(F.col("cy"), frame).alias("cy"), running_median(F.col("cx"), frame).alias("cx"))


def axis_checks(axis: DataFrame, by: list[str], ny: float, nx: float, jump: float) -> DataFrame:
    """Per group: points, out of bounds, jumps of ``jump`` or more, largest jump."""
    along = Window.partitionBy(*by).orderBy("z")
    step = F.hypot(F.col("cy") - F.lag("cy").over(along), F.col("cx") - F.lag("cx").over(along))
    outside = ~(F.col("cy").between(0, ny) & F.col("cx").between(0, nx))
    return axis.withColumn("step", step).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(outside).alias("n_outside"), F.count_if(F.col("step") >= jump).alias("n_jumps"), F.max("step").alias("max_step"))


def _bucketed(df: DataFrame, t: str, width: float) -> DataFrame:
    return df.withColumn("__b", F.floor(F.col(t) / width).cast("long"))


def asof(left: DataFrame, right: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """``left`` with ``before_t, before, after_t, after``: the values at or before, and at or after, its time.

    One union and two windows over each group in time order; nothing is joined, so the cost is one sort.
    """
    l = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast("double")})
    r = right.select(*by, t, F.col(value).cast("double").alias("__v")).withColumn("__side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    back = Window.partitionBy(*by).orderBy(F.col(t), "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*by).orderBy(F.col(t).desc(), "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("__side") == 0, F.struct(F.col(t).alias("t"), F.col("__v").alias("v")))
    out = both.withColumn("__back", F.last(known, ignorenulls=True).over(back)).withColumn("__ahead", F.last(known, ignorenulls=True).over(ahead))
    named = out.where("__side = 1").withColumns({"before_t": F.col("__back.t"), "before": F.col("__back.v"), "after_t": F.col("__ahead.t"), "after": F.col("__ahead.v")})
    return named.select(*left.columns, "before_t", "before", "after_t", "after")


def nearest(found: DataFrame, t: str) -> DataFrame:
    """Value of the nearest time of ``asof``, the earlier one on ties."""
    use_before = F.col("after_t").isNull() | (F.col(t) - F.col("before_t") <= F.col("after_t") - F.col(t))
    return found.withColumn("nearest", F.when(use_before, F.col("before")).otherwise(F.col("after")))


def interpolated(found: DataFrame, t: str) -> DataFrame:
    """Linear between the neighbours of ``asof``, clamped at both ends."""
    span = F.col("after_t") - F.col("before_t")
    between = F.col("before") + (F.col("after") - F.col("before")) * (F.col(t) - F.col("before_t")) / span
    return found.withColumn("value", F.when(F.col("before_t").isNull(), F.col("after")).when(F.col("after_t").isNull() | (span == 0), F.col("before")).otherwise(between))


def on_axis(points: DataFrame, axis: DataFrame) -> DataFrame:
    """``points`` with ``cy, cx``: the axis (``z, cy, cx``) interpolated at their own z, clamped at both ends.

    Points meet the axis by planes of unit height: for each plane that holds points, the control points in it with the last one below
    and the first one above. Only these planes are put in order, the points are one side of an equi-join.
    """
    control = axis.select(F.col("z").cast("double").alias("z"), F.col("cy").cast("double").alias("cy"), F.col("cx").cast("double").alias("cx"))
    held = control.groupBy(F.floor("z").alias("__k")).agg(F.array_sort(F.collect_list(F.struct("z", "cy", "cx"))).alias("c"))
    placed = points.withColumn("__k", F.floor(F.col("z").cast("double")))
    planes = placed.select("__k").distinct().join(held, "__k", "full")
    along = Window.orderBy("__k")  # a row a plane
    below = F.last(F.try_element_at("c", F.lit(-1)), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    above = F.first(F.try_element_at("c", F.lit(1)), ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    near = F.array_compact(F.concat(F.array(below), F.coalesce("c", F.array().cast("array<struct<z:double,cy:double,cx:double>>")), F.array(above)))
    found = placed.join(planes.select("__k", near.alias("__c")), "__k")
    t = F.col("z").cast("double")
    found = found.withColumns({"__p": F.try_element_at(F.filter("__c", lambda c: c["z"] <= t), F.lit(-1)), "__q": F.get(F.filter("__c", lambda c: c["z"] >= t), F.lit(0))})
    for c in ("cy", "cx"):
        ends = {"before_t": F.col("__p.z"), "before": F.col(f"__p.{c}"), "after_t": F.col("__q.z"), "after": F.col(f"__q.{c}")}
        found = interpolated(found.withColumns(ends), "z").withColumn(c, F.col("value"))
    return found.select(*points.columns, "cy", "cx")
