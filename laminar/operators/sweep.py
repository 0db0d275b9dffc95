"""Reports over fit windows: satisfaction by file, verdict counts, gates, radius gaps per winding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number_range(text: Column, side: str) -> Column:
    """Lowest or highest number of a dirty cell such as ``~2.8``, ``2.2-3.6``, ``n/r`` (null)."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))
    return F.array_min(found) if side == "low" else F.array_max(found)


def satisfaction(rows: DataFrame) -> DataFrame:
    """``source, satisfied, total, pct`` per source file."""
    out = rows.groupBy("source").agg(F.sum("satisfied").alias("satisfied"), F.sum("total").alias("total"))
    return out.withColumn("pct", 100.0 * F.col("satisfied") / F.col("total"))


def verdicts(windows: DataFrame) -> DataFrame:
    """``verdict, n, low, high, minutes`` per verdict label."""
    return windows.groupBy("verdict").agg(F.count("*").alias("n"), F.min("dr").alias("low"), F.max("dr").alias("high"), (F.sum("wall_s") / 60.0).alias("minutes"))


def gate(windows: DataFrame, rel: float, same: float, dr: float, tolerance: float) -> DataFrame:
    """One row: how many windows pass each gate and all of them."""
    r, s, d = F.col("rel_pct") >= rel, F.col("same_pct") >= same, F.abs(F.col("dr") - dr) <= tolerance
    return windows.agg(F.count("*").alias("n"), F.count_if(r).alias("rel_ok"), F.count_if(s).alias("same_ok"), F.count_if(d).alias("dr_ok"), F.count_if(r & s & d).alias("all_ok"))


def winding_gaps(vertices: DataFrame, least: int = 20) -> DataFrame:
    """``z, n_gaps, dr, iqr``: median radius per winding, gaps between consecutive windings, halved."""
    radius = vertices.groupBy("z", "w").agg(F.median("r").alias("r"), F.count("*").alias("c")).where(F.col("c") >= least)
    along = Window.partitionBy("z").orderBy("w")
    gap = radius.withColumn("gap", F.when(F.lead("w").over(along) == F.col("w") + 1, F.lead("r").over(along) - F.col("r"))).where("gap IS NOT NULL")
    p = F.percentile("gap", F.array(F.lit(0.25), F.lit(0.75)))
    return gap.groupBy("z").agg(F.count("*").alias("n_gaps"), (F.median("gap") / 2).alias("dr"), p.alias("p")).select("z", "n_gaps", "dr", (F.col("p")[1] - F.col("p")[0]).alias("iqr"))


def winding_radii(vertices: DataFrame, axis: DataFrame, planes: DataFrame, band: float = 30.0, least: int = 20) -> DataFrame:
    """``z0, w, z, r, n``-like rows for ``winding_gaps`` (``z, w, r``): mesh vertices ``w, z, y, x`` with positive coordinates within
    ``band`` of a plane ``z0``, with their distance from the axis (``z, cy, cx``) interpolated at their own z; windings with fewer than
    ``least`` vertices in a plane's band are left out."""
    from laminar.operators.axis import on_axis

    at = on_axis(vertices.where("z > 0 AND y > 0 AND x > 0"), axis)
    at = at.withColumn("r", F.hypot(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")))
    # planes are few and a band apart from each other or nearer: each vertex is keyed to the bands of width ``band`` around it
    key = F.floor(F.col("z") / band).cast("long")
    near = at.withColumn("k", F.explode(F.array(key - 1, key, key + 1)))
    both = near.join(planes.select("z0", F.floor(F.col("z0") / band).cast("long").alias("k")), "k").where(F.abs(F.col("z") - F.col("z0")) < band)
    full = both.groupBy("z0", "w").count().where(F.col("count") >= least).select("z0", "w")
    return both.join(full, ["z0", "w"], "left_semi").select(F.col("z0").alias("z"), "w", "r")


def seed_row(seeds: DataFrame, label: str, high: float = 97.0) -> DataFrame:
    """``label, line``: a Markdown row per window of ``label, seed, pct``: seeds, how many reach ``high`` percent, the list by falling share."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("pct")).alias("m"), "seed"))), lambda e: e["seed"].cast("string")), ", ")
    out = seeds.groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col("pct") >= high).alias("h"), listed.alias("l"))
    return out.select(label, F.format_string("| %s | %d | %d | %s |", F.col(label).cast("string"), "n", "h", "l").alias("line"))


def text_bar(n: Column, peak: Column, width: int = 40) -> Column:
    """A bar of ``#``, rounded half to even."""
    return F.repeat(F.lit("#"), F.bround(n * width / peak).cast("int"))
